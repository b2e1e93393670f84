"""Power-curve tables: points, summaries and gates (AGG-01, ORD-06, FLT-06, SNK-02 to SNK-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import general, half_even
from ..functions.windpower import BETZ, cp, theoretical_kw


def curve_points(curve: DataFrame, rho: float, diameter: float, wind: str = "wind", power: str = "power") -> DataFrame:
    """The rows with positive wind, with theoretical_power_kw and cp."""
    w, p = F.col(wind), F.col(power)
    return curve.where(w > 0).withColumns({"theoretical_power_kw": theoretical_kw(w, rho, diameter), "cp": cp(w, p, rho, diameter)})


def curve_summary(points: DataFrame, key: str, order: str, wind: str = "wind", power: str = "power", ct: str | None = None) -> DataFrame:
    """Per curve: rows, the point of the largest cp (the first one of a tie), and how many exceed the limit."""
    first = F.max(F.struct(F.col("cp"), (-F.col(order)).alias("o"), F.col(wind).alias("w"), F.col(power).alias("p"), F.col("theoretical_power_kw").alias("t"), (F.col(ct) if ct else F.lit(None).cast("double")).alias("c")))
    out = points.groupBy(key).agg(F.count("*").alias("row_count"), first.alias("m"), F.count_if(F.col("cp") > BETZ).alias("cp_above_betz_count"))
    return out.select(
        key, "row_count", F.col("m.cp").alias("cp_max"), F.col("m.w").alias("cp_max_wind_speed_ms"), F.col("m.p").alias("cp_max_power_kw"),
        F.col("m.t").alias("cp_max_theoretical_power_kw"), F.col("m.c").alias("cp_max_ct"), "cp_above_betz_count",
    )


def physical(summary: DataFrame, allow: bool = False) -> DataFrame:
    """The curves that no point of is above the limit, or all of them."""
    return summary if allow else summary.where("cp_above_betz_count = 0")


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits after the point, ties to even, or nothing for null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", half_even(value, digits))).otherwise("")


def csv_lines(points: DataFrame, key: str, order: str, wind: str = "wind", power: str = "power", digits: int = 6) -> DataFrame:
    """One CSV text per curve, in order."""
    line = F.concat_ws(",", F.col(wind).cast("string"), F.col(power).cast("string"), fixed(F.col("theoretical_power_kw"), digits), fixed(F.col("cp"), digits))
    head = "wind_speed_ms,power_kw,theoretical_power_kw,cp"
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    return points.groupBy(key).agg(F.concat_ws("\n", F.lit(head), F.transform(rows, lambda r: r["line"])).alias("csv"))


def markdown_report(points: DataFrame, key: str, order: str, wind: str = "wind", power: str = "power", digits: int = 4) -> DataFrame:
    """One Markdown table per curve, in order."""
    cells = [fixed(F.col(wind), 1), fixed(F.col(power), 1), fixed(F.col("theoretical_power_kw"), 2), fixed(F.col("cp"), digits)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| V (m/s) | P (kW) | Pw (kW) | Cp |\n| ---: | ---: | ---: | ---: |"
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    return points.groupBy(key).agg(F.concat_ws("\n", F.lit(head), F.transform(rows, lambda r: r["line"])).alias("report"))


def full_report(points: DataFrame, key: str, order: str, rho: float, diameter: float, digits: int = 4, wind: str = "wind", power: str = "power", ct: str | None = None) -> DataFrame:
    """One Markdown text per curve: parameters, the summary and all points (SNK-02)."""
    summary = curve_summary(points, key, order, wind, power, ct)
    c = F.col(ct) if ct else F.lit(None).cast("double")
    cells = [general(F.col(wind).cast("double")), fixed(F.col(power), 1), fixed(c, 3), fixed(F.col("theoretical_power_kw"), 1), fixed(F.col("cp"), digits)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    table = points.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("line")))), lambda r: r["line"]).alias("lines"))
    area = 3.141592653589793 * diameter * diameter / 4
    found = [
        F.concat(F.lit("- `Cp,max`：`"), fixed(F.col("cp_max"), 6), F.lit("`")), F.concat(F.lit("- 对应风速：`"), general(F.col("cp_max_wind_speed_ms").cast("double")), F.lit(" m/s`")),
        F.concat(F.lit("- 对应功率：`"), fixed(F.col("cp_max_power_kw"), 1), F.lit(" kW`")), F.concat(F.lit("- 对应理论风功率：`"), fixed(F.col("cp_max_theoretical_power_kw"), 1), F.lit(" kW`")),
    ]
    thrust = F.when(F.col("cp_max_ct").isNotNull(), F.concat(F.lit("- 对应 Ct：`"), fixed(F.col("cp_max_ct"), 3), F.lit("`")))
    many = F.concat(F.lit("- 异常提示：有 `"), F.col("cp_above_betz_count").cast("string"), F.lit(f"` 个 Cp 超过贝茨极限 `{BETZ}`。"))
    warning = F.when(F.col("cp_above_betz_count") > 0, many).otherwise(F.lit(f"- 异常提示：未发现 Cp 超过贝茨极限 `{BETZ}`。"))
    head = f"# Cp 计算结果\n\n## 参数\n\n- 空气密度 rho：`{rho:g} kg/m^3`\n- 叶轮直径 D：`{diameter:g} m`\n- 扫掠面积 A：`{area:.3f} m^2`\n\n## 最终结果\n"
    body = "\n## 明细\n\n| 风速 (m/s) | 功率 (kW) | Ct | 理论风功率 (kW) | Cp |\n|---:|---:|---:|---:|---:|"
    text = F.concat(F.concat_ws("\n", F.lit(head), *found, thrust, warning, F.lit(body), F.col("lines")), F.lit("\n"))  # concat_ws leaves out what is null
    return summary.join(table, key).select(key, text.alias("report"))


def json_report(points: DataFrame, key: str, order: str, wind: str = "wind", power: str = "power", ct: str | None = None) -> DataFrame:
    """One JSON text per curve: its summary and all points, in order (SNK-04)."""
    c = (F.col(ct) if ct else F.lit(None).cast("double")).alias("ct")
    point = F.struct(F.col(wind).alias("wind_speed_ms"), F.col(power).alias("power_kw"), c, "theoretical_power_kw", "cp")
    rows = points.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, point.alias("p")))), lambda r: r["p"]).alias("points"))
    summary = curve_summary(points, key, order, wind, power, ct)
    fields = [x for x in summary.columns if x != key]
    return summary.join(rows, key).select(key, F.to_json(F.struct(F.struct(*fields).alias("summary"), "points"), {"ignoreNullFields": "false"}).alias("json"))


def output_format(path: Column, explicit: Column) -> Column:
    """What is asked for, else what the path's suffix tells, else Markdown (SNK-06)."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(suffix == ".csv", "csv").when(suffix == ".json", "json"), F.lit("markdown"))


#: Fixed value: the rows that the workbook's table has room for.
WORKBOOK_ROWS = 100


def beyond_workbook(points: DataFrame, key: str) -> DataFrame:
    """The curves with more rows than the workbook has room for, and how many they have (the check of SNK-07)."""
    return points.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > WORKBOOK_ROWS)
