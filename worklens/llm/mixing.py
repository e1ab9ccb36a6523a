"""Mixing sources to target weights over a tree of domains, languages and sources.

A token budget goes down the tree: each node's budget is split among its children in
proportion to their weights, no child getting more than it can supply (its tokens times
``epochs``). What a short child leaves goes to its siblings, again by weight; as a node's
supply is the sum of its leaves', only what the siblings cannot take reaches the ancestor's
other children. Each leaf then gives its budget as a prefix of seeded epochs: whole passes over
all its documents, and of the next pass the documents, in an order drawn from (seed, pass, id),
as long as their tokens fit.

The order of a leaf is never gathered in one task: its documents fall into buckets of the
drawn order, bucket totals say which buckets are wholly in or out, and only the bucket that the
budget ends in (``BUCKET_ROWS`` rows on average) is put in order.

Edge cases: tokens are runs other than ASCII white space; null and empty texts have none, take
no budget and go with every pass their leaf gives, partial ones included. A null language or
source is a leaf of its own, apart from an empty one. Nulls as ids share one draw; at equal draws the
fewer tokens come first. Repeated rows count each. A weight that is not given is 1, a tree without tokens or an empty table gives no copies.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from worklens.llm.common import stage, table

SEED = 20
FRACTION = 0.8
EPOCHS = 2
BUCKET_ROWS = 8192
LEVELS = ("domain", "lang", "source")
#: Target weights of languages; domains and sources weigh the same among their siblings.
WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
DOMAINS = 4
_NONE = "<none>"


def domain_of(source: Column) -> Column:
    """Sources are dealt to domains by a hash: the tables name no domain."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source), 1, 4), 16, 10).cast("int") % DOMAINS).cast("string"))


def shares(leaves: DataFrame, fraction: float, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Budget of every leaf (the levels, n, tokens) by water-filling from the root down."""
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(fraction))).first()[0]
    out = leaves.withColumn("supply", F.col("tokens") * epochs).withColumn("budget", F.lit(int(total)).cast("long"))
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[:depth + 1]), list(LEVELS[:depth])
        weight = F.lit(1)
        for name, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == name, w).otherwise(weight)
        node = out.groupBy(*path).agg(F.sum("supply").alias("cap"), F.min("budget").alias("up")).withColumn("w", weight)
        least = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), level)
        before, after = least.rowsBetween(Window.unboundedPreceding, -1), least.rowsBetween(0, Window.unboundedFollowing)
        filled = (node.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("w").over(after))
                  .withColumn("rate", F.greatest(F.col("up") - F.col("spent"), F.lit(0)).cast("double") / F.col("open")))
        # children fill up in the order of supply by weight; the first that does not sets the rate of all after it
        short = F.col("cap") <= F.col("rate") * F.col("w")
        level_rate = F.min(F.when(~short, F.struct("spent", "rate"))).over(Window.partitionBy(*parent))["rate"]
        given = filled.withColumn("short", short).withColumn("level_rate", level_rate).select(
            *path, F.when(F.col("short"), F.col("cap")).otherwise(F.floor(F.col("level_rate") * F.col("w"))).cast("long").alias("given"))
        out = out.join(given, path).withColumn("budget", F.col("given")).drop("given")
    return out.select(*LEVELS, "n", "tokens", "budget")


def draw(seed: int, turn: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, keep: list[Column], fraction: float = FRACTION, epochs: int = EPOCHS,
        weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """The kept columns with domain, tokens and copies: how many passes take the document."""
    name = lambda c: F.coalesce(F.col(c), F.lit(_NONE))
    rows = stage(docs.select(
        *keep, domain_of(name("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), F.col("doc_id").alias("__id"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens")))
    leaves = rows.groupBy(*LEVELS).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    budget = (shares(stage(leaves), fraction, epochs, WEIGHTS if weights is None else weights)
              .withColumn("turns", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("long"))
              .withColumn("rest", F.col("budget") - F.col("turns") * F.col("tokens"))
              .withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS))
              .withColumnRenamed("tokens", "leaf_tokens").drop("n", "budget"))
    drawn = rows.join(stage(budget), list(LEVELS)).withColumn("h", draw(seed, F.col("turns"), F.col("__id")))
    unit = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = drawn.withColumn("bucket", F.floor(unit * F.col("buckets")))
    totals = drawn.groupBy(*LEVELS, "bucket").agg(F.sum("tokens").alias("held"), F.min("rest").alias("limit"))
    ahead = F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    totals = stage(totals.withColumn("upto", ahead).withColumn("before", F.col("upto") - F.col("held"))
                   .withColumn("whole", F.col("upto") <= F.col("limit")).drop("held", "limit"))
    placed = drawn.join(totals, [*LEVELS, "bucket"])
    inside = (F.col("before") <= F.col("rest")) & ~F.col("whole")
    out = [c for c in rows.columns if c != "__id"]
    # at equal draws the order is by tokens, so rows that are equal here are equal in what they take
    order = Window.partitionBy(*LEVELS, "bucket").orderBy("h", "tokens", "__id").rowsBetween(Window.unboundedPreceding, 0)
    cut = (placed.where(inside).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
           .withColumn("copies", F.col("turns") + (F.col("upto") <= F.col("rest")).cast("long")))
    rest = placed.where(~inside).withColumn("copies", F.col("turns") + F.col("whole").cast("long"))
    live = F.col("leaf_tokens") > 0
    return cut.union(rest.select(cut.columns)).select(*out, F.when(live, F.col("copies")).otherwise(0).cast("long").alias("copies"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, [F.col("doc_id")]).select("doc_id", "domain", "lang", "source", "tokens", "copies")


def repeat_to_mix(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it.

    Copies are joined on the hashes of text and id; of rows repeated in both, every one is taken alike.
    """
    keyed = docs.withColumn("__row", F.xxhash64("text")).withColumn("__idh", F.xxhash64("doc_id", "lang", "source"))
    mixed = mix(keyed, [F.col("__row"), F.col("__idh")])
    taken = mixed.groupBy("__row", "__idh").agg(F.max("copies").alias("__copies")).where("__copies > 0")
    return (keyed.join(taken, ["__row", "__idh"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
            .select(*docs.columns))


def _oracle() -> str:
    """The same mix in DuckDB, with every leaf's whole order."""
    ctes, source = [], "tree0"
    for depth, level in enumerate(LEVELS):
        path, parent = ", ".join(LEVELS[:depth + 1]), ", ".join(LEVELS[:depth]) or "1"
        w = "case " + " ".join(f"when {level} = '{k}' then {v}" for k, v in WEIGHTS.get(level, {"": 1}).items()) + " else 1 end"
        ctes.append(f"""
node{depth} as (select {path}, sum(supply)::bigint as cap, min(budget) as up, {w} as w from {source} group by {path}),
fill{depth} as (select *, coalesce(sum(cap) over (partition by {parent} order by cap / w, {level} rows between unbounded preceding and 1 preceding), 0)::bigint as spent,
    sum(w) over (partition by {parent} order by cap / w, {level} rows between current row and unbounded following)::bigint as open from node{depth}),
rate{depth} as (select *, greatest(up - spent, 0)::double / open as rate from fill{depth}),
level{depth} as (select *, min(case when cap > rate * w then {{'spent': spent, 'rate': rate}} end) over (partition by {parent}) as lv from rate{depth}),
tree{depth + 1} as (select t.* exclude (budget), (case when cap <= rate * w then cap else floor(lv.rate * w) end)::bigint as budget
    from {source} t join level{depth} using ({path}))""")
        source = f"tree{depth + 1}"
    leaf = ", ".join(LEVELS)
    return f"""
with rows as (select doc_id, 'domain' || ((('0x' || md5(source)[1:4])::bigint) % {DOMAINS}) as domain, lang, source, tokens from
  (select doc_id, coalesce(lang, '{_NONE}') as lang, coalesce(source, '{_NONE}') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens from documents)),
leaves as (select {leaf}, sum(tokens)::bigint as tokens from rows group by all),
tree0 as (select *, tokens * {EPOCHS} as supply, floor((select sum(tokens) from leaves)::double * {FRACTION})::bigint as budget from leaves),{",".join(ctes)},
leaf as (select {leaf}, tokens as leaf_tokens, case when tokens > 0 then budget // tokens else 0 end as turns from {source}),
want as (select l.*, t.budget - l.turns * l.leaf_tokens as rest from leaf l join {source} t using ({leaf})),
drawn as (select r.*, w.turns, w.rest, w.leaf_tokens, md5('{SEED}:' || w.turns || ':' || coalesce(doc_id::varchar, 'null')) as h from rows r join want w using ({leaf}))
select doc_id, domain, lang, source, tokens, (case when leaf_tokens = 0 then 0 else turns
    + (sum(tokens) over (partition by {leaf} order by h, tokens, doc_id rows unbounded preceding) <= rest)::bigint end)::bigint as copies from drawn"""


ORACLE = _oracle()
