"""Secret scan in SQL functions only: assignments, access keys, hex runs and high-entropy strings.

The first three kinds are patterns. The fourth is Shannon entropy over a sliding window of
``WINDOW`` characters of every candidate string (a run of at least that many letters, digits
and ``+/_=-`` with a digit in it). A fold moves the window by one character at a time: it
takes the leaving character out of the counts, puts the entering one in and adjusts the sum of
c * log2(c), kept as whole thousandths so that no rounding builds up. A step takes the same time for
every character, so a candidate of any length (an embedded image, a certificate) is scanned in linear time. Each class of windows has
its own threshold, and the best window of each decides: hex digits only in lower or in upper
case, digits with lower and upper case, digits with upper case only and digits with lower case
only. The last two hold nothing but letters and digits, as words joined by ``-``, ``_`` or ``/``
are as varied as keys. Patterns' spans and words of the allow-list (placeholders) are cut out of a
candidate and every piece that is left is scored by itself, so that they suppress only the
windows that touch them; a piece that is a UUID is no secret. Pattern spans always stay.

Spans count code points, the end is exclusive.

Edge cases: a null text is an empty one and has no span; whole texts are scanned whatever their
length; repeated rows give repeated results; null ids are carried along. Only the id and the text
are read, so other columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from worklens.llm.common import table

# The patterns of the three base kinds, in their order.
KINDS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_SECRET = 6
WINDOW = 20
BITS = {"hex": 2.9, "mixed": 3.7, "upper_hex": 2.9, "upper": 3.5, "lower": 3.5}
#: These (in either case) are no part of a secret, nor are UUIDs secrets.
ALLOWED = ("example", "sample", "dummy", "placeholder", "changeme", "your_", "your-", "xxxx", "0123456789", "deadbeef")
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: c * log2(c) in thousandths, for c from 0 to WINDOW.
WEIGHTS = [0] + [round(1000 * c * math.log2(c)) for c in range(1, WINDOW + 1)]
#: The largest sum of weights that a window over the threshold has.
LIMITS = {k: math.floor(1000 * WINDOW * (math.log2(WINDOW) - v)) for k, v in BITS.items()}
_PLACES = "array<struct<start:int,end:int>>"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _hits(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _spans(text: Column, pattern: str, hits: Column, rank: int, kind: str, good: Column | None = None) -> Column:
    """Places of the hits, from the lengths of the text between them. ``good``: which hits to keep."""
    pieces = F.split(text, pattern, -1)
    none = F.array().cast(_SPAN)
    start = lambda acc, x: acc["at"] + F.length(x["piece"])
    span = lambda acc, x: F.struct(
        start(acc, x).alias("start"), F.lit(rank).alias("rank"), (start(acc, x) + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"))
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit"),
                          (good if good is not None else F.transform(hits, lambda h: F.lit(True))).alias("good"))
    folded = F.aggregate(
        zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda acc, x: F.struct((start(acc, x) + F.length(x["hit"])).alias("at"),
                                F.when(x["good"], F.concat(acc["spans"], F.array(span(acc, x)).cast(_SPAN))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return F.when(F.size(hits) > 0, folded).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _codes(string: Column) -> Column:
    """A candidate's characters as numbers: digits 0-9, lower case 10-35, upper case 36-61, signs from 62 on."""
    def code(c: Column) -> Column:
        return _let(F.ascii(c), lambda a: F.when(a < ord(":"), F.when(a >= ord("0"), a - ord("0")).otherwise(F.when(a == ord("+"), 62).when(a == ord("-"), 63).otherwise(64)))
                    .when(a >= ord("a"), a - ord("a") + 10).when((a >= ord("A")) & (a <= ord("Z")), a - ord("A") + 36).otherwise(F.when(a == ord("="), 65).otherwise(66)))
    return F.transform(F.filter(F.split(string, ""), lambda c: c != ""), code)


def _least_sums(string: Column) -> Column:
    """Struct (one field for each of ``BITS``): the least sum of weights over the string's windows of the class.

    One fold over the characters; whatever a step needs twice is evaluated once, so it takes the same time for every character.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weight = lambda c: F.get(weights, c)
    within = lambda c, a, b: c.between(a, b).cast("int")
    classes = {
        "hexes": lambda c: within(c, 0, 15),
        "upper_hexes": lambda c: within(c, 0, 9) + within(c, 36, 41),
        "digits": lambda c: within(c, 0, 9),
        "lowers": lambda c: within(c, 10, 35),
        "uppers": lambda c: within(c, 36, 61),
    }
    moves = _let(_codes(string), lambda codes: F.transform(codes, lambda c, i: F.struct(
        c.alias("enters"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(-1).alias("leaves"), (i >= WINDOW - 1).alias("full"))))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        total = F.when(enters == leaves, acc["total"]).otherwise(_let(
            F.struct(F.get(acc["counts"], enters).alias("a"), F.get(acc["counts"], leaves).alias("b")),
            lambda n: acc["total"] + weight(n["a"] + 1) - weight(n["a"]) + F.when(leaves >= 0, weight(n["b"] - 1) - weight(n["b"])).otherwise(0)))
        counts = F.when(enters == leaves, acc["counts"]).otherwise(F.transform(
            acc["counts"], lambda c, j: F.when(j == enters, c + 1).when(j == leaves, c - 1).otherwise(c)))
        sums = {k: acc[k] + f(enters) - F.when(leaves >= 0, f(leaves)).otherwise(0) for k, f in classes.items()}

        def best(now: Column) -> Column:
            digits, lowers, uppers = now["digits"], now["lowers"], now["uppers"]
            holds = {
                "hex": now["hexes"] == WINDOW,
                "mixed": (digits > 0) & (lowers > 0) & (uppers > 0),
                "upper_hex": now["upper_hexes"] == WINDOW,
                "upper": (digits > 0) & (uppers > 0) & (digits + uppers == WINDOW),
                "lower": (digits > 0) & (lowers > 0) & (digits + lowers == WINDOW),
            }
            return F.struct(
                now["counts"].alias("counts"), now["total"].alias("total"), *[now[k].alias(k) for k in classes],
                *[F.when(x["full"] & holds[k], F.least(acc[k], now["total"])).otherwise(acc[k]).alias(k) for k in BITS])

        return _let(F.struct(counts.alias("counts"), total.alias("total"), *[v.alias(k) for k, v in sums.items()]), best)

    top = F.lit(WEIGHTS[-1] + 1)
    start = F.struct(F.array_repeat(F.lit(0), 67).alias("counts"), F.lit(0).alias("total"), *[F.lit(0).alias(k) for k in classes],
                     *[top.alias(k) for k in BITS])
    return F.aggregate(moves, start, step, lambda acc: F.struct(*[acc[k].alias(k) for k in BITS]))


def _suspicious(string: Column) -> Column:
    over = F.exists(F.array(_least_sums(string)), lambda s: reduce(or_, [s[k] <= LIMITS[k] for k in BITS]))
    return F.when(string.rlike("[0-9]") & ~string.rlike(UUID), over).otherwise(False)


def _runs(word: str) -> str:
    """A pattern of a word and whatever further ones overlap it, each with the one before."""
    again = [word[n:] for n in range(1, len(word)) if word.endswith(word[:n])]
    return word + (f"(?:{'|'.join(sorted(again, key=len))})*+" if again else "")


def _allowed(string: Column, at: Column) -> Column:
    """Places (start, end) of the allow-list words in a string that starts at ``at``; overlapping ones of a word are one place."""
    plain = F.lower(string)

    def places(word: str) -> Column:
        hits = F.regexp_extract_all(plain, F.lit(_runs(word)), F.lit(0))
        between = F.arrays_zip(F.split(plain, _runs(word), -1).alias("piece"), hits.alias("hit"))
        folded = F.aggregate(
            F.filter(between, lambda x: x["hit"].isNotNull()), F.struct(at.alias("at"), F.array().cast(_PLACES).alias("out")),
            lambda acc, x: _let(acc["at"] + F.length(x["piece"]), lambda start: F.struct(
                (start + F.length(x["hit"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"))).cast(_PLACES)).alias("out"))),
            lambda acc: acc["out"])
        return F.when(plain.contains(word), folded).otherwise(F.array().cast(_PLACES))
    return F.concat(*[places(w) for w in ALLOWED])


def _pieces(text: Column, candidate: Column, base: Column) -> Column:
    """What base spans and allow-list words leave of a candidate: spans of at least ``WINDOW`` characters."""
    start, end = candidate["start"], candidate["end"]
    place = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end"))).cast(_PLACES)
    covered = F.transform(F.filter(base, lambda b: (b["start"] < end) & (start < b["end"])), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    cuts = F.sort_array(F.concat(covered, _allowed(F.substring(text, start + 1, end - start), start)))
    add = lambda acc, to: F.when(to - acc["at"] >= WINDOW, F.concat(acc["out"], place(acc["at"], to))).otherwise(acc["out"])
    left = F.aggregate(
        cuts, F.struct(start.alias("at"), F.array().cast(_PLACES).alias("out")),
        lambda acc, c: F.struct(F.greatest(acc["at"], c["end"]).alias("at"), add(acc, c["start"]).alias("out")),
        lambda acc: add(acc, end))
    return F.transform(left, lambda p: F.struct(p["start"].alias("start"), candidate["rank"].alias("rank"), p["end"].alias("end"), candidate["kind"].alias("kind")))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``base`` and ``extra``: sorted arrays of spans (start, rank, end, kind)."""
    kinds = list(KINDS)
    found = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).select(
        "*", *[_hits(F.col("__text"), KINDS[k]).alias(f"__{k}") for k in kinds], _hits(F.col("__text"), CANDIDATE).alias("__candidate"))
    column = F.col("__text")
    secrets = F.transform(_hits(column, KINDS["assign"], 2), lambda s: F.length(s) >= LEAST_SECRET)
    placed = found.select(
        *keep,
        F.sort_array(F.concat(*[_spans(column, KINDS[k], F.col(f"__{k}"), i, k, secrets if k == "assign" else None)
                                for i, k in enumerate(kinds)])).alias("__base"),
        _spans(column, CANDIDATE, F.col("__candidate"), len(kinds), "entropy").alias("__run"), "__text")
    pieces = F.flatten(F.transform("__run", lambda c: _pieces(column, c, F.col("__base"))))
    clear = F.filter(pieces, lambda p: _suspicious(F.substring(column, p["start"] + 1, p["end"] - p["start"])))
    return placed.select(*keep, F.col("__base").alias("base"), clear.alias("extra"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_entropy"))


MASK = "[SECRET]"


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every span found is replaced by a mark, overlapping spans by one; n_chars follows the text.

    A text without spans stays as it is, and so does a null.
    """
    columns = docs.columns
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col("text").alias("__whole"))
    found = find_secrets(bare, ["__row", "__whole"], "__whole").withColumn("__all", F.sort_array(F.concat("base", "extra")))
    text = F.col("__whole")
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(
            acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)))).alias("parts"))
    masked = F.aggregate("__all", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), step,
                         lambda acc: F.concat(F.concat_ws("", acc["parts"]), F.substring(text, acc["at"] + 1, F.length(text))))
    out = found.select("__row", F.when(F.size("__all") > 0, masked).otherwise(text).alias("__new"), (F.size("__all") > 0).alias("__hit"))
    own = lambda c: F.col("__row")[c]
    pick = {"text": F.col("__new"), "n_chars": F.when(F.col("__hit"), F.length("__new")).otherwise(own("n_chars")) if "n_chars" in columns else None}
    return out.select(*[(pick.get(c) if pick.get(c) is not None else own(c)).cast(docs.schema[c].dataType).alias(c) for c in columns])


def _oracle() -> str:
    """The same result in DuckDB. Counts of every window are taken afresh there."""
    classes = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
               "access": KINDS["access"], "hex": KINDS["hex"], "entropy": CANDIDATE}
    parts = []
    for rank, (kind, r) in enumerate(classes.items()):
        good = f"length(g) >= {LEAST_SECRET}" if kind == "assign" else "true"
        parts.append(f"""select rid, {rank} as rank, '{kind}' as kind, h as hit,
            (sum(length(p) + length(h)) over (partition by rid order by i) - length(h))::bigint as s,
            (sum(length(p) + length(h)) over (partition by rid order by i))::bigint as e, {good} as good
          from (select rid, unnest(regexp_extract_all(t, '{r}', 0)) as h, unnest(regexp_extract_all(t, '{r}', {2 if kind == "assign" else 0})) as g,
                       unnest(string_split_regex(t, '{r}')[1:len(regexp_extract_all(t, '{r}', 0))]) as p,
                       unnest(range(len(regexp_extract_all(t, '{r}', 0)))) as i
                from d where regexp_matches(t, '{r}'))""")
    words = ", ".join(f"'{w}'" for w in ALLOWED)
    match = {
        "hex": "regexp_full_match(w, '[0-9a-f]+')",
        "mixed": "(regexp_matches(w, '[0-9]') and regexp_matches(w, '[a-z]') and regexp_matches(w, '[A-Z]'))",
        "upper_hex": "regexp_full_match(w, '[0-9A-F]+')",
        "upper": "(regexp_full_match(w, '[0-9A-Z]+') and regexp_matches(w, '[0-9]') and regexp_matches(w, '[A-Z]'))",
        "lower": "(regexp_full_match(w, '[0-9a-z]+') and regexp_matches(w, '[0-9]') and regexp_matches(w, '[a-z]'))",
    }
    hot = " or ".join(f"({m} and total <= {LIMITS[k]})" for k, m in match.items())
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(parts)}),
base as (select * from found where kind <> 'entropy' and good),
runs as (select rid, s, hit, lower(hit) as low from found where kind = 'entropy' and regexp_matches(hit, '[0-9]')),
cuts as (select runs.rid, runs.s as c, base.s as a, base.e as b from runs join base on base.rid = runs.rid and base.s < runs.s + length(runs.hit) and runs.s < base.e
         union all select rid, s as c, s + k - 1 as a, s + k - 1 + length(word) as b
         from (select rid, s, low, word, unnest(range(1, length(low) + 1)) as k from runs, (select unnest([{words}]) as word) where contains(low, word)) where low[k:k + length(word) - 1] = word),
spots as (select rid, s as c, s + i - 1 as pos, hit[i] as ch from (select rid, s, hit, unnest(range(1, length(hit) + 1)) as i from runs)),
clear as (select rid, c, pos, ch, pos - row_number() over (partition by rid, c order by pos) as island from spots
          where not exists (select 1 from cuts where cuts.rid = spots.rid and cuts.c = spots.c and cuts.a <= spots.pos and spots.pos < cuts.b)),
cand as (select rid, {len(KINDS)} as rank, 'entropy' as kind, min(pos) as s, max(pos) + 1 as e, string_agg(ch, '' order by pos) as hit from clear group by rid, c, island
         having count(*) >= {WINDOW} and regexp_matches(string_agg(ch, '' order by pos), '[0-9]') and not regexp_matches(string_agg(ch, '' order by pos), '{UUID}')),
wins as (select rid, s, hit[k:k+{WINDOW - 1}] as w from (select rid, s, hit, unnest(range(1, length(hit) - {WINDOW - 2})) as k from cand)),
chars as (select rid, s, w, unnest(string_split(w, '')) as c from (select distinct rid, s, w from wins)),
sums as (select rid, s, w, sum({WEIGHTS}[n + 1]) as total from (select rid, s, w, c, count(*) as n from chars group by all) group by all),
hot as (select distinct rid, s from sums where {hot}),
extra as (select cand.* from cand join hot using (rid, s)),
b as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as txt from base group by rid),
a as (select rid, count(*) filter (kind = 'entropy') as n_entropy, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as txt
      from (select rid, rank, kind, s, e from base union all select rid, rank, kind, s, e from extra) group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(b.txt, '')) as base_sha256, coalesce(a.txt, '') as spans, coalesce(n_entropy, 0) as n_entropy
from d left join b using (rid) left join a using (rid)"""


ORACLE = _oracle()
