"""Board tables made from the star-schema tables by expressions that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, condition, columns, distinct)
TABLES: dict[str, tuple[str, str, dict[str, str], bool]] = {
    "pads": ("part", "true", {
        "id": "concat('P', cast(p_partkey as string))", "x": "cast(p_partkey % 50 as double)", "y": "cast(floor(p_partkey / 50) as double)",
        "size_x": "2e-1 + 1e-1 * (p_size % 7)", "size_y": "2e-1 + 1e-1 * (p_size % 7)", "layer": "cast(p_partkey % 2 as string)", "net_id": "p_brand",
        "drill": "case when p_partkey % 3 = 0 then 1e-1 * (p_size % 9) end"}, False),
    "tracks": ("orders", "true", {
        "id": "concat('T', cast(o_orderkey as string))", "x1": "cast(o_custkey % 50 as double)", "y1": "cast(floor(o_custkey / 50) as double)",
        "x2": "cast(o_custkey % 50 + o_orderkey % 3 as double)", "y2": "cast(floor(o_custkey / 50) as double)", "width": "1e-1 + 5e-2 * (o_orderkey % 4)",
        "layer": "cast(o_orderkey % 2 as string)", "net_id": "case when o_orderkey % 7 = 0 then null else concat('N', cast(o_custkey % 11 as string)) end"}, False),
    "slanted": ("orders", "true", {
        "id": "concat('T', cast(o_orderkey as string))", "x1": "cast(o_custkey % 50 as double)", "y1": "cast(floor(o_custkey / 50) as double)",
        "x2": "cast(o_custkey % 50 + o_orderkey % 3 as double)", "y2": "cast(floor(o_custkey / 50) + o_orderkey % 4 as double)", "width": "5e-2 + 5e-2 * (o_orderkey % 4)",
        "layer": "cast(o_orderkey % 40 as string)", "net_id": "case when o_orderkey % 7 = 0 then null else concat('N', cast(o_custkey % 11 as string)) end"}, False),
    "round_pads": ("part", "true", {
        "id": "concat('P', cast(p_partkey as string))", "x": "p_partkey % 50 + 3e-1", "y": "floor(p_partkey / 50) + 2e-1",
        "size_x": "2e-1 + 1e-1 * (p_size % 7)", "size_y": "2e-1 + 1e-1 * (p_size % 7)", "shape": "'C'", "layer": "cast(p_partkey % 40 as string)", "net_id": "p_brand"}, False),
    "drills": ("supplier", "true", {
        "id": "concat('D', cast(s_suppkey as string))", "x": "(7 * s_suppkey) % 50 + 5e-2", "y": "(13 * s_suppkey) % 40 + 5e-2", "diameter": "2e-1 + 1e-1 * (s_suppkey % 5)"}, False),
    "pin_edges": ("lineitem", "true", {"component_id": "concat('K', cast(l_orderkey as string))", "net_id": "concat('N', cast(l_partkey % 997 as string))"}, True),
    "components": ("lineitem", "true", {
        "id": "concat('K', cast(l_orderkey as string))", "kind": "case l_orderkey % 3 when 0 then 'resistor' when 1 then 'capacitor' else 'inductor' end",
        "value": "case l_orderkey % 3 when 0 then concat(cast(l_orderkey % 90 + 10 as string), 'K') when 1 then concat(cast(l_orderkey % 9 + 1 as string), 'N') else concat(cast(l_orderkey % 5 + 1 as string), 'U') end"}, True),
    "power": ("part", "p_partkey % 997 < 40", {"net_id": "concat('N', cast(p_partkey % 997 as string))"}, True),
    "ground": ("part", "p_partkey % 997 between 40 and 79", {"net_id": "concat('N', cast(p_partkey % 997 as string))"}, True),
    "claims": ("lineitem", "true", {
        "subject_id": "cast(l_orderkey as string)", "field": "l_returnflag", "value": "l_linestatus", "source": "cast(l_suppkey % 8 as string)",
        "independent_group": "case when l_linenumber = 7 then null else cast(l_linenumber as string) end", "confidence": "l_discount * 9"}, False),
    "labels_of_nets": ("part", "true", {
        "net_id": "concat('L', cast(p_partkey as string))", "scope": "cast(p_partkey % 37 as string)", "fanout": "p_size % 6",
        "label": "concat(case p_partkey % 16 when 0 then 'SDA' when 1 then 'SCL' when 2 then 'USB_DP' when 3 then 'USB_DM' when 4 then 'SYS_CLK' when 5 then '3V3' when 6 then '+5V' when 7 then 'GND' when 8 then 'NRST' when 9 then 'TX' when 10 then 'RX' when 11 then 'CANH' when 12 then 'DQ' when 13 then 'DATA_' when 14 then 'PAIR' else 'MOSI' end, case when p_partkey % 16 in (12, 13) then cast(cast(floor(p_partkey / 16) as bigint) % 8 as string) when p_partkey % 16 = 14 and p_partkey % 3 = 0 then '_P' when p_partkey % 16 = 14 then '_N' else '' end)"}, False),
    "few_pins": ("orders", "true", {"component_id": "concat('K', cast(o_orderkey as string))", "net_id": "concat('N', cast(o_custkey as string))"}, True),
    "segments": ("lineitem", "true", {
        "net_id": "concat('N', cast(l_partkey % 997 as string))", "length": "l_quantity", "width": "1e-1 + l_tax"}, False),
}
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the driver's own."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, condition, columns, distinct = TABLES[name]
    out = spark.read.parquet(f"{sf_dir}/{base}.parquet").where(condition).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])
    return out.distinct() if distinct else out


def sql(names: str, body: str) -> str:
    """body with the named derived tables in front; it may go on with further tables after a comma."""
    parts = []
    for name in names.split():
        base, condition, columns, distinct = TABLES[name]
        fields = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {'DISTINCT ' * distinct}{fields} FROM {base} WHERE {condition})")
    body = body.strip()
    return "WITH RECURSIVE " + ", ".join(parts) + (", " if not body.upper().startswith("SELECT") else " ") + body
