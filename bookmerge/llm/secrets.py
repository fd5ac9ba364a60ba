"""Secret scans: patterns, and sliding-window Shannon entropy per character class, in Spark functions only.

Offsets come from the pieces between matches (``split``) and the matches themselves
(``regexp_extract_all``) of one pattern. A candidate is a maximal run of 20 or more key characters. Its character class fixes
window and threshold; a window slides over it, and a step changes the counts of two characters, the one that
comes and the one that goes, and the sum of c * log2(c). The two counts are those in the characters that stay, so a
step costs no more than a window's width, whatever the run's length. Arrays that lambdas read are bound as variables,
and results are appended in blocks of ``BLOCK``, so work grows in proportion to the text. A
candidate that an allow rule knows (UUIDs, labelled checksums) is suppressed, and so is one inside a span of a base
kind. Segments are what separators (/ = _ -) leave of a run. A path or slug (separators, and one letter case or no digit)
is not judged as a whole: each segment of 20 or more is a candidate of its own, by its own class. In other
runs, segments that hold a placeholder word fall out and what lies between them is judged. One narrow projection: no
shuffle, no Python.

Edge cases: a null or empty text has no spans; repeated rows are scanned each; spans of one start are
in the order assign, access, hex, entropy; offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.llm._shared import pick, read

# Kinds in order, with their patterns.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
#: Character class: pattern, window, least entropy in bits.
CLASSES = [("^[0-9A-Fa-f]+$", 32, 3.0), ("^[A-Za-z0-9]+$", 20, 3.5), ("^.+$", 24, 3.7)]
#: Candidates that are no secrets.
ALLOW = [
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    "(?i)^(sha1|sha256|sha384|sha512|md5)[-=_]",  # a labelled checksum
]
#: Words of placeholders: they allow the segment that holds one, not the run.
WORDS = "(?i:example|sample|placeholder|x{6}|abcdefgh|01234567)"
PLACEHOLDER = f"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?{WORDS}[A-Za-z0-9+]*"
SEPARATORS = "/=_-"
#: A path or slug: of one letter case or without digits, with separators.
SLUG = "^(?=[^/=_-]*[/=_-])(?:[a-z0-9/_=-]+|[A-Z0-9/_=-]+|[A-Za-z+/_=-]+)$"
LEAST = 20

_FOUND = "array<struct<start:int,end:int,kind:int,match:string>>"
#: Elements that one array grows by appending; more are appended in blocks, so that no append copies a long array.
BLOCK = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where lambdas in ``use`` read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, zero: Column, total: Callable[[Column], Column], join: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """One pass over an array with a carried value: for each item ``emit`` (null: nothing) of the value before it and the item.

    ``total`` is an item's part in the carried value and ``join`` adds two parts.
    """
    none = F.array().cast(kind)

    def over(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK)))

        def bases(bs: Column) -> Column:
            step = lambda s, block: F.struct(F.aggregate(block, s["at"], lambda v, x: join(v, total(x))).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("base"), block.alias("block"))).alias("out"))
            start = F.struct(zero.alias("at"), F.transform(F.slice(bs, 1, 0), lambda block: F.struct(zero.alias("base"), block.alias("block"))).alias("out"))
            return F.aggregate(bs, start, step, lambda s: s["out"])

        def inside(block: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                one = emit(s["at"], x)
                return F.struct(join(s["at"], total(x)).alias("at"), F.when(one.isNotNull(), F.array_append(s["out"], one)).otherwise(s["out"]).alias("out"))

            return F.aggregate(block["block"], F.struct(block["base"].alias("at"), none.alias("out")), step, lambda s: s["out"])

        return F.flatten(F.transform(_bound(blocks, bases), inside))

    return F.when(F.size(items) > 0, _bound(items, over)).otherwise(none)


def _located(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start,end,kind,match>> of all matches (those whose group has ``least`` code points)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), groups.alias("g"))
    length = lambda x: F.coalesce(F.length(x), F.lit(0))
    sized = F.transform(zipped, lambda x: F.struct(length(x["gap"]).alias("gap"), length(x["m"]).alias("n"), x["m"].alias("m"), length(x["g"]).alias("g")))

    def one(at: Column, x: Column) -> Column:
        a = at + x["gap"]
        return F.when(x["m"].isNotNull() & (x["g"] >= least), F.struct(a.alias("start"), (a + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("match")))

    return _scan(sized, F.lit(0), lambda x: x["gap"] + x["n"], lambda a, b: a + b, one, _FOUND)


def _c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _hot_window(match: Column, window: int, threshold: float) -> Column:
    """struct<lo,hi>: from the first to the last window whose entropy reaches the threshold (hi is 0 without one).

    The state of the scan has a count for each of the run's characters and the sum of n * log2(n) over them; a step changes two of each.
    """

    def over(codes: Column) -> Column:
        places = lambda known: F.transform(codes, lambda c: F.array_position(known, c).cast("int") - 1)
        return _bound(F.array_distinct(codes), lambda known: _bound(places(known), lambda p: scan(p, F.size(known))))

    def scan(places: Column, n_known: Column) -> Column:
        width = F.least(F.lit(window), F.size(places))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.array_repeat(F.lit(0), n_known).alias("counts"))

        def step(s: Column, i: Column) -> Column:
            comes, goes = F.element_at(places, i), F.when(i > width, F.get(places, i - width - 1))

            def counted(pair: Column) -> Column:
                came, went = pair["came"], pair["went"]
                less = F.coalesce(_c_log_c(went + 1) - _c_log_c(went), F.lit(0.0))  # the one that goes, among those that stay
                more = _c_log_c(came + 1) - _c_log_c(came)
                counts = F.transform(s["counts"], lambda c, k: c + (k == comes).cast("int") - F.coalesce((k == goes).cast("int"), F.lit(0)))

                def end(total: Column) -> Column:
                    hot = (i >= width) & (F.log2(width.cast("double")) - total / width >= threshold - 1e-9)
                    return F.struct(total.alias("sum"), F.when(hot & (s["hi"] == 0), i - width).otherwise(s["lo"]).alias("lo"), F.when(hot, i).otherwise(s["hi"]).alias("hi"), counts.alias("counts"))

                return _bound(s["sum"] + more - less, end)

            same = F.coalesce((comes == goes).cast("int"), F.lit(0))
            return _bound(F.struct((F.get(s["counts"], comes) - same).alias("came"), (F.get(s["counts"], goes) - 1).alias("went")), counted)

        return F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))

    return _bound(F.transform(F.split(match, ""), lambda c: F.ascii(c)), over)


def _hot(match: Column) -> Column:
    cases = None
    for pattern, window, threshold in CLASSES:
        value = _hot_window(match, window, threshold)
        cases = F.when(match.rlike(pattern), value) if cases is None else cases.when(match.rlike(pattern), value)
    return cases


def _pieces(run: Column, cut: str) -> Column:
    """What lies between the matches of ``cut`` in a run, without outer separators."""
    match = run["match"]
    zipped = F.arrays_zip(F.split(match, cut, -1).alias("gap"), F.regexp_extract_all(match, F.lit(cut), F.lit(0)).alias("m"))
    moved = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), (F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("n")))

    def one(at: Column, x: Column) -> Column:
        core = F.trim(x["gap"], F.lit(SEPARATORS))
        a = at + F.length(x["gap"]) - F.length(F.ltrim(x["gap"], F.lit(SEPARATORS)))
        return F.when(F.length(core) >= LEAST, F.struct(a.alias("start"), (a + F.length(core)).alias("end"), run["kind"].alias("kind"), core.alias("match")))

    return _scan(moved, run["start"], lambda x: x["n"], lambda a, b: a + b, one, _FOUND)


def _outside(candidates: Column, spans: Column) -> Column:
    """Candidates that lie in none of the spans: one pass over both in order of their starts, with the farthest end of the spans so far."""
    event = lambda x, kind, match: F.struct(x["start"].alias("start"), F.lit(kind).alias("own"), x["end"].alias("end"), match.alias("match"))
    events = F.array_sort(F.concat(F.transform(spans, lambda x: event(x, 0, F.lit(None).cast("string"))), F.transform(candidates, lambda x: event(x, 1, x["match"]))))
    ahead = lambda x: F.when(x["own"] == 0, x["end"]).otherwise(F.lit(0))
    one = lambda upto, x: F.when((x["own"] == 1) & (x["end"] > upto), F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(3).alias("kind"), x["match"].alias("match")))
    return _scan(events, F.lit(0), ahead, F.greatest, one, _FOUND)


def _allowed(match: Column) -> Column:
    return match.rlike("|".join(f"(?:{a})" for a in ALLOW))


def _candidates(runs: Column) -> Column:
    """Runs, or the pieces of them that are judged apart; one without a letter is a number or a ruler."""
    known = F.filter(runs, lambda r: r["match"].rlike("[A-Za-z]") & ~_allowed(r["match"]))
    whole = lambda r: F.when(r["match"].rlike(SLUG), _pieces(r, f"[{SEPARATORS}]+")).when(r["match"].rlike(WORDS), _pieces(r, PLACEHOLDER)).otherwise(F.array(r))
    return F.filter(F.flatten(F.transform(known, whole)), lambda r: r["match"].rlike("[A-Za-z]") & ~r["match"].rlike(WORDS) & ~_allowed(r["match"]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus base_spans and all_spans: array<struct<start,end,kind>>, ordered; kind counts along KINDS."""
    none = F.array().cast(_FOUND)
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    t = F.col(text)
    some = lambda pattern, value: F.when(t.rlike(pattern), value).otherwise(none)
    df = docs.select("*", some(ASSIGN, _located(t, ASSIGN, 0, 2, 8)).alias("__assign"), some(ACCESS, _located(t, ACCESS, 1)).alias("__access"), some(HEX, _located(t, HEX, 2)).alias("__hex"), some(RUN, _located(t, RUN, 3)).alias("__runs"))
    df = df.withColumn("base_spans", F.array_sort(plain(F.concat("__assign", "__access", "__hex"))))
    df = df.withColumn("__candidates", F.when(F.size("__runs") > 0, _candidates(F.col("__runs"))).otherwise(none))
    df = df.withColumn("__open", F.when((F.size("__candidates") > 0) & (F.size("base_spans") > 0), _outside(F.col("__candidates"), F.col("base_spans"))).otherwise(F.col("__candidates")))
    hot = F.transform("__open", lambda r: F.struct(r["start"].alias("start"), _hot(r["match"]).alias("w")))
    df = df.withColumn("__entropy", F.when(F.size("__open") > 0, hot))
    spans = F.transform(F.filter("__entropy", lambda r: r["w"]["hi"] > 0), lambda r: F.struct((r["start"] + r["w"]["lo"]).alias("start"), F.lit(3).alias("kind"), (r["start"] + r["w"]["hi"]).alias("end")))
    df = df.withColumn("all_spans", F.when(F.col("__entropy").isNull(), F.col("base_spans")).otherwise(F.array_sort(F.concat("base_spans", spans))))
    return df.drop("__assign", "__access", "__hex", "__runs", "__candidates", "__open", "__entropy")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(pick(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(said("base_spans").cast("binary"), 256).alias("base_sha256"), said("all_spans").alias("spans"))
