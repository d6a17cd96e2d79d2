"""Variation graphs seen in the driver's tables. Each lens is SQL that Spark and DuckDB both run, so that an operator
and its oracle start from the same rows.

orders:    a walk is an order, its nodes the suppliers of its lines; four loci by order key.
timeline:  nodes are days, or a day's event type; a walk is a user; three loci by user. A reference walk (-1) sees
           every day, and links are the pairs seen in walks.
template:  one locus per supplier with a five-node reference and one alternative node, lengths by key; as GFA text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from walkloom.model import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

ORDER_STEPS = """
    select 'L' || cast(l_orderkey % 4 as string) as locus_id, cast(l_orderkey as bigint) as walk_pos,
           cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as bigint) as step_pos,
           cast(l_suppkey as string) as id, l_returnflag = 'R' as rev
    from lineitem"""
ORDER_WALKS = """
    select 'L' || cast(o_orderkey % 4 as string) as locus_id, cast(o_orderkey as bigint) as walk_pos, 'W' as kind, 's' || cast(o_custkey % 20 as string) as sample,
           cast(o_custkey % 2 as int) as hap, 'chr' || cast(o_custkey % 5 as string) as seq_id, cast(0 as bigint) as start, cast(100 as bigint) as "end", cast(o_custkey % 3 + 1 as bigint) as weight
    from orders"""
ORDER_SEGMENTS = """
    select 'L' || cast(k as string) as locus_id, cast(s_suppkey as string) as id, cast(s_suppkey as bigint) as seg_pos, cast(1 + s_suppkey % 50 as bigint) as length
    from supplier, (select 0 as k union all select 1 union all select 2 union all select 3) t"""
#: A reference with repeats: the suppliers of each locus's orders, end to end.
ORDER_REFERENCE = f"""
    select locus_id, cast(-1 as bigint) as walk_pos, cast(row_number() over (partition by locus_id order by walk_pos, step_pos) - 1 as bigint) as step_pos, id, rev
    from ({ORDER_STEPS}) s"""

_DAYS = """
    select distinct user_id % 3 as k, cast(year(ts) * 400 + month(ts) * 32 + day(ts) as bigint) as d from events"""
_VISITS = """
    select user_id, cast(year(ts) * 400 + month(ts) * 32 + day(ts) as bigint) as d, min(event_type) as kind from events group by 1, 2"""
TIME_STEPS = f"""
    select 'T' || cast(user_id % 3 as string) as locus_id, cast(user_id as bigint) as walk_pos, cast(row_number() over (partition by user_id order by d) - 1 as bigint) as step_pos,
           'd' || cast(d as string) || case when (user_id + d) % 3 = 0 then ':' || kind else '' end as id, false as rev
    from ({_VISITS}) v
    union all
    select 'T' || cast(k as string), cast(-1 as bigint), cast(row_number() over (partition by k order by d) - 1 as bigint), 'd' || cast(d as string), false
    from ({_DAYS}) r"""
TIME_SEGMENTS = f"""
    select locus_id, id, cast(row_number() over (partition by locus_id order by id) as bigint) as seg_pos,
           cast(case when id like '%:%' then 3 * length(id) - 12 else 10 + cast(substr(id, 2) as bigint) % 7 end as bigint) as length
    from (select distinct locus_id, id from ({TIME_STEPS}) s) n"""
TIME_LINKS = f"""
    select locus_id, from_id, to_id, false as from_rev, false as to_rev, cast(row_number() over (partition by locus_id order by from_id, to_id) as bigint) as link_pos
    from (select distinct locus_id, from_id, to_id from (select locus_id, id as from_id, lead(id) over (partition by locus_id, walk_pos order by step_pos) as to_id from ({TIME_STEPS}) s) p where to_id is not null) e"""

#: Lengths of the reference and the alternative allele of a template locus.
TEMPLATE = """
    select 'S' || cast(s_suppkey as string) as locus_id, cast(1 + s_suppkey % 70 as bigint) as ref_len, cast(1 + (s_suppkey * 7) % 80 as bigint) as alt_len, cast(1 + s_suppkey % 3 as bigint) as w
    from supplier"""


def _spark_sql(sql: str) -> str:
    return sql.replace('"end"', "`end`")


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


_registered: dict[str, str] = {}


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables of a folder, which are registered once for a session and folder."""
    session = str(spark._jsparkSession.sessionUUID())
    if _registered.get(session) != sf_dir or not all(spark.catalog.tableExists(t) for t in TABLES[-1:]):
        register(spark, sf_dir)
        _registered[session] = sf_dir
    return spark.sql(_spark_sql(sql))


def _full(df: DataFrame, ddl: str) -> DataFrame:
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    want = T._parse_datatype_string(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    from walkloom.model import LINKS, SEGMENTS, STEPS, WALKS

    steps = rows(spark, sf_dir, ORDER_STEPS)
    links = spark.createDataFrame([], LINKS)
    return Graph(_full(rows(spark, sf_dir, ORDER_SEGMENTS), SEGMENTS), links, _full(rows(spark, sf_dir, ORDER_WALKS), WALKS), _full(steps, STEPS))


def time_graph(spark: SparkSession, sf_dir: str) -> Graph:
    from pyspark.sql import functions as F

    from walkloom.model import LINKS, SEGMENTS, STEPS, WALKS

    steps = rows(spark, sf_dir, TIME_STEPS)
    walks = steps.select("locus_id", "walk_pos").distinct().select("locus_id", "walk_pos", F.lit("W").alias("kind"), F.when(F.col("walk_pos") < 0, "ref").otherwise(F.concat(F.lit("u"), F.col("walk_pos").cast("string"))).alias("sample"), F.lit(0).alias("hap"), F.lit("time").alias("seq_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(1).cast("long").alias("weight"))
    return Graph(_full(rows(spark, sf_dir, TIME_SEGMENTS), SEGMENTS), _full(rows(spark, sf_dir, TIME_LINKS), LINKS), _full(walks, WALKS), _full(steps, STEPS))


def template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GFA text of the template loci: reference ref 1>2>3>4>5, r1 like it, and alt (weight w) 1>2>20>4>5."""
    from pyspark.sql import functions as F

    t = rows(spark, sf_dir, TEMPLATE)
    seq = lambda n: F.rpad(F.lit(""), n, "ACGTACGTAC")
    seg = lambda i, n: F.concat(F.lit(f"S\t{i}\t"), seq(n))
    link = lambda a, b: F.lit(f"L\t{a}\t+\t{b}\t+\t0M")
    span = lambda n: (n + F.lit(140)).cast("string")
    walk = lambda s, n, path, *more: F.concat(F.lit(f"W\t{s}\t0\tchr1\t0\t"), span(n), F.lit(f"\t{path}"), *more)
    lines = F.array(
        F.lit("H\tVN:Z:1.1\tRS:Z:ref"), seg(1, F.lit(50)), seg(2, F.lit(20)), seg(3, F.col("ref_len")), seg(4, F.lit(20)), seg(5, F.lit(50)), seg(20, F.col("alt_len")),
        link(1, 2), link(2, 3), link(3, 4), link(4, 5), link(2, 20), link(20, 4),
        walk("ref", F.col("ref_len"), ">1>2>3>4>5"), walk("r1", F.col("ref_len"), ">1>2>3>4>5"), walk("alt", F.col("alt_len"), ">1>2>20>4>5", F.lit("\tWT:i:"), F.col("w").cast("string")),
    )
    return t.select("locus_id", F.posexplode(lines).alias("line_pos", "value")).withColumn("line_pos", F.col("line_pos").cast("long"))
