"""Problem 2: the best representative of each group of records of one act.

Groups are the connected components of a bipartite graph: one node for each (institution, type, number, year),
one for each (institution, content hash), and an edge for each pair of nodes that some record has together.
A component's records are reduced to at most 288 cells (completeness x trust x attributes present, each
with its latest record) by partial aggregation, so a group of any size fits one row. Of the cells, dominance layers are
computed: those that no cell dominates are the first, and so on. The survivor is chosen within the first layer, and what it lacks, or
others know better, comes from the first layer of the cells that have it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.operators.components import components
from lavra.operators.skew import join_counted
from lavra.session import Scratch

# The act types, and how each reads in capitals without accents.
ACT_TYPES = {
    "RESOLUCAO": "Resolução",
    "PORTARIA": "Portaria",
    "ATO": "Ato",
    "DELIBERACAO": "Deliberação",
    "INSTRUCAO": "Instrução",
    "COMUNICADO": "Comunicado",
}
ATTRIBUTES = ("act_type", "act_number", "act_year")


def read_type(value: Column) -> Column:
    """The act type that ``value`` names, whatever its case, accents and outer blanks, else NULL."""
    bare = F.upper(F.translate(F.regexp_replace(F.lower(value), r"(?U)^\s+|\s+$", ""), "áàâãäéèêëíìîïóòôõöúùûüç", "aaaaaeeeeiiiiooooouuuuc"))
    bare = F.regexp_replace(bare, r"\p{M}", "")
    return F.coalesce(*[F.when(bare == k, F.lit(v)) for k, v in ACT_TYPES.items()])


def read_number(value: Column) -> Column:
    """The first run of digits without leading zeros (any length), else NULL."""
    run = F.regexp_extract(value, r"([0-9]+)", 1)
    return F.when(run != "", F.regexp_replace(run, r"^0+(?=[0-9])", ""))


def read_year(value: Column) -> Column:
    """The first run of digits; below 50 it is 20yy, from 50 to 99 it is 19yy; else NULL."""
    run = read_number(value)
    short = F.length(run) <= 2
    two = F.when(short, run.cast("int"))
    return F.when(short & (two < 50), (two + 2000).cast("string")).when(short, (two + 1900).cast("string")).otherwise(run)


def _filled(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def as_read(records: DataFrame, origins: DataFrame) -> DataFrame:
    """The columns that grouping and choosing need; ``origins`` is a small fixed table of sources."""
    trust = origins.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("trust").alias("trust"))
    own = F.col("act_type")
    read = records.select(
        F.col("result_id").alias("id"),
        "institution",
        "source",
        F.coalesce(read_type(own), read_type(F.col("heading_type"))).alias("act_type"),
        read_number(F.col("act_number")).alias("act_number"),
        read_year(F.col("act_year")).alias("act_year"),
        F.when(F.col("content_hash") != "", F.col("content_hash")).alias("hash"),
        F.col("collected_at").alias("at"),
        (
            read_type(own).isNotNull().cast("int")
            + read_number(F.col("act_number")).isNotNull().cast("int")
            + read_year(F.col("act_year")).isNotNull().cast("int")
            + _filled(F.col("act_date")).cast("int")
            + _filled(F.col("publication_page")).cast("int")
        ).alias("complete"),
    )
    return read.join(trust, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0))).drop("source")


def record_groups(read: DataFrame, scratch: Scratch) -> DataFrame:
    """``read`` with the group's id ``gid``: the smallest record id among its keys. Records without any key
    belong to no group and are left out, as are those of a NULL institution."""
    keys = ["institution", "act_type", "act_number", "act_year"]
    hashes = ["institution", "hash"]
    by_key = scratch.write(read.dropna(subset=keys).groupBy(*keys).agg(F.min("id").alias("kid"), F.count("*").alias("nk")), "by_key")
    by_hash = scratch.write(read.dropna(subset=hashes).groupBy(*hashes).agg(F.min("id").alias("hid"), F.count("*").alias("nh")), "by_hash")
    noted = join_counted(read, by_key, keys, "nk", ["id"], "left")
    noted = scratch.write(join_counted(noted, by_hash, hashes, "nh", ["id"], "left").drop("nk", "nh"), "noted")
    # Nodes: 2 x smallest id for a key, the same plus 1 for a hash.
    edges = noted.select((F.col("kid") * 2).alias("a"), (F.col("hid") * 2 + 1).alias("b")).dropna().distinct()
    label = components(edges, scratch)
    node = F.coalesce(F.col("kid") * 2, F.col("hid") * 2 + 1)
    sizes = scratch.write(noted.select(node.alias("node")).dropna().groupBy("node").agg(F.count("*").alias("n")), "sizes")
    sizes = scratch.write(
        sizes.join(label, "node", "left").select("node", "n", F.coalesce("label", "node").alias("gid")), "labelled"
    )
    return join_counted(noted.withColumn("node", node), sizes, ["node"], "n", ["id"]).drop("node", "n", "kid", "hid")


def _dominates(d: Column, c: Column, by: tuple[str, ...]) -> Column:
    no_worse = reduce(and_, (d[x] >= c[x] for x in by))
    return no_worse & reduce(or_, (d[x] > c[x] for x in by))


def _first_layer(cells: Column, by: tuple[str, ...]) -> Column:
    """The cells that no other dominates."""
    return F.filter(cells, lambda c: ~F.exists(cells, lambda d: _dominates(d, c, by)))


def _donor(attribute: str) -> Column:
    """The cell whose value of ``attribute`` is taken: of the first layer, over trust and recency, of the cells that have one, the most
    trusted, then latest, then smallest id."""
    having = F.filter("cells", lambda x: x[attribute].isNotNull())
    named = lambda x: F.struct(x["trust"].alias("trust"), x["age"].alias("age"), x["neg"].alias("neg"), x[attribute].alias("value"), x["layer"].alias("layer"))
    return F.array_max(F.transform(_first_layer(having, ("trust", "age")), named))


def best_records(records: DataFrame, origins: DataFrame) -> DataFrame:
    """One row for each group of two or more records.

    Columns: survivor_id, act_type, act_number, act_year ('' where no record of the group has a value),
    group_size, skyline (cells no record dominates in completeness, trust and recency) and layers (dominance
    layers from which the three values came, 1 being the skyline, 0 for none).

    The survivor is the first layer's record by completeness, trust, recency and smallest id. Of the records that have a value, the
    first layer over trust and recency gives it, there the most trusted, then latest, then smallest id. NULL times are oldest, unknown sources have trust 0, NULL
    institutions match nothing. result_id must be unique; columns besides those named are ignored.
    """
    scratch = Scratch(records.sparkSession, "best")
    grouped = record_groups(as_read(records, origins), scratch)
    age = F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(2**63)))
    has = [F.col(c).isNotNull().alias(f"has_{c}") for c in ATTRIBUTES]
    cells = grouped.select("gid", "complete", "trust", *has, F.struct(age.alias("age"), (-F.col("id")).alias("neg"), *ATTRIBUTES).alias("best"))
    cells = cells.groupBy("gid", "complete", "trust", *[f"has_{c}" for c in ATTRIBUTES]).agg(F.max("best").alias("best"), F.count("*").alias("n"))
    cell = F.struct("complete", "trust", F.col("best.age").alias("age"), F.col("best.neg").alias("neg"), *[F.col(f"best.{c}").alias(c) for c in ATTRIBUTES])
    groups = cells.groupBy("gid").agg(F.sum("n").alias("group_size"), F.sort_array(F.collect_list(cell), asc=False).alias("cells")).where("group_size > 1")
    # In this order a cell comes after all that dominate it: its layer is one more than the deepest of theirs.
    start = F.array().cast("array<struct<complete:int,trust:int,age:bigint,neg:bigint,act_type:string,act_number:string,act_year:string,layer:int>>")

    def add(done: Column, c: Column) -> Column:
        above = F.transform(F.filter(done, lambda d: _dominates(d, c, ("complete", "trust", "age"))), lambda d: d["layer"])
        return F.concat(done, F.array(c.withField("layer", F.coalesce(F.array_max(above), F.lit(0)) + 1)))

    layered = groups.withColumn("cells", F.aggregate("cells", start, add))
    values, layers = [], []
    for c in ATTRIBUTES:
        donor = _donor(c)
        values.append(F.coalesce(donor["value"], F.lit("")).alias(c))
        layers.append(F.coalesce(donor["layer"], F.lit(0)))
    # A cell's fields are in the order of the policy.
    survivor = F.array_max(F.filter("cells", lambda x: x["layer"] == 1))
    return layered.select(
        (-survivor["neg"]).alias("survivor_id"),
        *values,
        "group_size",
        F.size(F.filter("cells", lambda x: x["layer"] == 1)).alias("skyline"),
        F.array(*layers).alias("layers"),
    )
