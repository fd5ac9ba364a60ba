"""Duplicate detection: lossless candidate keys, rule scores, name / phone / email signals, routing.

A book is a DataFrame of contact columns; a pair is a DataFrame with structs ``a`` and ``b`` (``a`` has
the lesser id), each the contact with its normalised form and derived keys computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookmerge.functions import arrays as X
from bookmerge.functions import contacts as C
from bookmerge.functions import names as M
from bookmerge.functions import normalize as N
from bookmerge.operators.graph import clusters, durable
from bookmerge.operators.ranges import numbered
from bookmerge.schemas import Settings

# Points of the components, and what is said of each.
POINTS = {"email": 60, "phone": 60, "exact_name": 30, "similar_name": 20, "organization": 10, "address": 10, "domain_mismatch": -10, "different_info": -20}
REASONS = [("email", "Same email address"), ("phone", "Same phone number"), ("exact_name", "Exact name match"), ("similar_name", "Similar names"), ("organization", "Same company"), ("address", "Same address"), ("domain_mismatch", "⚠️ Different email domains"), ("different_info", "⚠️ Different contact info")]


def prepared(book: DataFrame, nicknames: tuple[tuple[str, ...], ...] | None = None) -> DataFrame:
    """(id, c, n, extra): the contact, its normalised form, and what the signals need.

    Written once: pairs then read plain columns instead of normalising a record for each pair. Records are dealt over the tasks
    first: normalising one costs far more than moving it, and a small file would come as one task.
    """
    parts = int(book.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = C.as_struct(C.completed(book).repartition(parts, "contact_id"), "c")
    df = df.select(F.col("c.contact_id").alias("id"), "c", C.normalized(F.col("c")).alias("n"))
    df = M.with_nickname_group(df, F.col("c.given_name"), "nickname_group", nicknames)
    extra = F.struct(
        "nickname_group",
        M.soundex_variant(F.col("n.family_name")).alias("soundex"),
        F.transform(C.values(F.col("c.phones")), N.digits_of).alias("digits"),
        F.transform(C.values(F.col("c.emails")), F.lower).alias("emails"),
        F.coalesce(N.trimmed(F.lower(F.col("c.nickname"))), F.lit("")).alias("nickname"),
    )
    return durable(df.select("id", "c", "n", extra.alias("extra"), N.normalize_name(F.col("n.full_name")).alias("sim")))


def _slim(side: DataFrame) -> DataFrame:
    """What candidate keys are made of. ``bare``: no email and no phone; ``marked``: a stored nickname or a one-letter given name."""
    n = F.col("n")
    marked = (F.col("extra.nickname") != "") | (F.length(n["given_name"]) == 1)
    return side.select("id", n["full_name"].alias("name"), "sim", n["family_name"].alias("family"), n["organization"].alias("org"), n["address"].alias("place"), n["emails"].alias("emails"), n["phones"].alias("phones"), (~C.has_contact(n)).alias("bare"), marked.alias("marked"))


def contact_keys(side: DataFrame) -> DataFrame:
    """(id, key) for each email and phone of prepared records."""
    tagged = lambda tag, v: F.transform(v, lambda x: F.concat(F.lit(tag), x))
    return side.select("id", F.explode(F.concat(tagged("E:", F.col("n.emails")), tagged("P:", F.col("n.phones")))).alias("key"))


def _alias_list() -> Column:
    """What records share whose emails are aliases or whose phones end alike: such a pair scores 30 if it also has one full name, organisation and address."""
    n, e = F.col("n"), F.col("extra")
    who = F.concat_ws("\n", n["full_name"], n["organization"], n["address"])
    tails = F.transform(F.filter(e["digits"], lambda d: F.length(d) >= 7), lambda d: F.concat(F.lit("S:"), F.right(d, F.lit(7))))
    stems = F.transform(e["emails"], lambda m: F.concat(F.lit("M:"), N.alias_key(m)))
    keys = F.transform(F.array_compact(F.array_distinct(F.concat(tails, stems))), lambda k: F.concat_ws("\n", k, who))
    return F.when((n["full_name"] != "") & (n["organization"] != "") & (n["address"] != ""), F.coalesce(keys, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def _alias_keys(side: DataFrame) -> DataFrame:
    """(id, key) for each alias key of prepared records."""
    return side.select("id", F.explode(_alias_list()).alias("key"))


def hot_keys(a: DataFrame, b: DataFrame | None = None, max_key_fanout: int = 1000) -> DataFrame:
    """(key, records): the emails and phones of more records than ``max_key_fanout``, for a log."""
    keys = contact_keys(a) if b is None else contact_keys(a).unionByName(contact_keys(b))
    return keys.groupBy("key").agg(F.count("*").alias("records")).where(F.col("records") > max_key_fanout)


def _many(side: DataFrame) -> DataFrame:
    """A side of a join with as many rows as there are records or pairs: merged, never broadcast, since the bytes of a written table
    tell nothing of its rows (12.7 million pairs were written as 8 MB), and the driver gathers and unpacks what is broadcast."""
    return side.hint("merge")


def _pairs_on(x: DataFrame, y: DataFrame, keys: list[str], test: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(id_a, id_b, more) of rows of x and y that agree in keys; test reads the columns of both as x.* and y.*, more names columns of x."""
    on = F.lit(True) if test is None else test
    for k in keys:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    return x.alias("x").join(_many(y.alias("y")), on).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), *(F.col(f"x.{c}") for c in more))


#: Records of one key that one task compares with as many others.
BLOCK = 1000
#: Blocks of one key at most; beyond, its blocks get larger, so that rows grow with the records and not with their square.
MOST_BLOCKS = 32


#: Pairs that a task makes, about.
PAIRS_A_TASK = 1_000_000


def _tasks(spark: SparkSession, pairs: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, -(-pairs // PAIRS_A_TASK)))


def pairs_by_key(ka: DataFrame, kb: DataFrame | None = None, block: int = BLOCK, keyed: bool = False) -> DataFrame:
    """(id_a, id_b) of rows (id, key) that agree in key, once for each key they share; within ka, the lesser id first, if kb is None. ``keyed`` adds the key.

    Rows may have ``before``, the keys of their record that come before key in an order of all keys: two rows then meet at the first
    key they share alone, so a pair comes once and no table of pairs is made distinct.
    A key of more than ``block`` records is cut into blocks of as many (larger ones beyond ``MOST_BLOCKS``), numbered in ranges of (key, id); a pair of
    blocks is a join key of its own. So the pairs of one key are dealt over all tasks, and a record travels once for each block of its key.
    The rows meet in merge joins (``_many``): written bytes tell nothing of the rows, nor of the copies that blocks make.
    Tasks go with the pairs, since the rows' bytes tell nothing of those either.
    """
    within = kb is None
    kb = ka if within else kb
    order = F.col("x.id") < F.col("y.id") if within else F.lit(True)
    once = ["before"] if "before" in ka.columns else []
    if once:
        order = order & ~F.arrays_overlap("x.before", "y.before")
    n = lambda k, name: k.groupBy("key").agg(F.count("*").alias(name))
    width = lambda c: F.greatest(F.lit(block), F.ceil(F.col(c) / MOST_BLOCKS)).cast("long")
    blocks = lambda c: F.ceil(F.col(c) / width(c)).cast("int")
    sizes = n(ka, "n_a").where("n_a > 1").withColumn("n_b", F.col("n_a")) if within else n(ka, "n_a").join(_many(n(kb, "n_b")), "key")
    sizes = durable(sizes.where("key is not null"))
    is_hot = F.greatest("n_a", "n_b") > block
    total = sizes.agg(F.sum(F.when(is_hot, F.col("n_a") * F.col("n_b"))).alias("hot"), F.sum(F.when(~is_hot, F.col("n_a") * F.col("n_b"))).alias("calm")).first()
    more = ("key",) if keyed else ()

    def met(x: DataFrame, y: DataFrame, keys: list[str], pairs: int) -> DataFrame:
        parts = _tasks(x.sparkSession, pairs)
        return _pairs_on(x.repartition(parts, *keys), y.repartition(parts, *keys), keys, order, more)

    calm = lambda k: k.join(hot, "key", "left_anti")
    few = lambda x, y: met(x, y, ["key"], total["calm"]) if (total["calm"] or 0) > PAIRS_A_TASK else _pairs_on(x, y, ["key"], order, more)
    if total["hot"] is None:
        return few(ka, kb)
    hot = durable(sizes.where(is_hot).select("key", blocks("n_a").alias("of_a"), blocks("n_b").alias("of_b"), width("n_a").alias("width_a"), width("n_b").alias("width_b")))
    cut = lambda k, width: numbered(k.join(hot, "key"), ["key"], "id", "place").withColumn("block", F.floor(F.col("place") / F.col(width)).cast("int"))
    a = durable(cut(ka, "width_a"))
    b = a if within else cut(kb, "width_b")
    last = lambda c: F.col(c) - 1
    x = a.select("id", "key", *once, F.col("block").alias("at_a"), F.explode(F.sequence(F.col("block") if within else F.lit(0), last("of_b"))).alias("at_b"))
    y = b.select("id", "key", *once, F.explode(F.sequence(F.lit(0), F.col("block") if within else last("of_a"))).alias("at_a"), F.col("block").alias("at_b"))
    return few(calm(ka), calm(kb)).unionByName(met(x, y, ["key", "at_a", "at_b"], total["hot"]))


def _both_ways(bare: DataFrame, other: DataFrame, within: bool, make) -> DataFrame:
    """Pairs of a bare record of one side with a record of the other; within one book the lesser id goes first."""
    if within:
        found = make(bare.where("bare"), other)
        return found.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    turned = make(other.where("bare"), bare).select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))
    return make(bare.where("bare"), other).unionByName(turned)


def _lossless_ids(a: DataFrame, b: DataFrame, within: bool, settings: Settings, max_key_fanout: int | None) -> DataFrame:
    """(id_a, id_b) of every pair that can pass ``scored``.

    By the points, a pair that scores 30 shares an email or a phone, or
    * it has one full name, organisation and address, and one of the two is bare, or a signal lifts it (an alias or the last
      digits that both share, ``_alias_keys``, or those of names below), or
    * it has one full name, or similar names and one organisation or address, and one of the two is bare: two
      records with contact data of their own lose 20 points and can't reach 30.
    With one full name alone a pair has 30 points, so at a confirm score of 50 it also needs a signal: those that
    records of one full name can have take a marked record or different family names.
    """
    order = F.col("x.id") < F.col("y.id") if within else F.lit(True)
    ka, kb = contact_keys(a), contact_keys(b)
    if max_key_fanout is None:
        found = [pairs_by_key(ka, None if within else kb)]
    else:
        hot = durable(hot_keys(a, None if within else b, max_key_fanout).select("key"))
        calm = lambda k: k.join(hot, "key", "left_anti")
        hubs = lambda k: k.join(hot, "key").groupBy("key").agg(F.min("id").alias("id"))
        found = [pairs_by_key(calm(ka), None if within else calm(kb)), _pairs_on(hubs(ka), kb.join(hot, "key", "left_semi"), ["key"], order)]
        if not within:
            found.append(_pairs_on(ka.join(hot, "key", "left_semi"), hubs(kb), ["key"]))
    found.append(pairs_by_key(_alias_keys(a), None if within else _alias_keys(b)))
    return reduce(DataFrame.unionByName, [*found, _ids_without_contact(a, b, within, settings)]).distinct()


def _ids_without_contact(a: DataFrame, b: DataFrame, within: bool, settings: Settings) -> DataFrame:
    """(id_a, id_b), with repeats: the part of ``_lossless_ids`` for pairs that share no email, phone or alias of one."""
    order = F.col("x.id") < F.col("y.id") if within else F.lit(True)
    found = []
    x, y = _slim(a), _slim(b)
    whole = "name <> '' and org <> '' and place <> ''"
    # two whole records with contact data of their own have 30 points: like those of one name they need a signal
    lifted = F.lit(True) if settings.confirm_score < 50 else F.expr("x.bare or y.bare or x.marked or y.marked or x.family <> y.family")
    found.append(_pairs_on(x.where(whole), y.where(whole), ["name", "org", "place"], order & lifted))
    named = lambda side: side.where("name <> ''").select("id", "name", "family", "bare", "marked")

    def same_name(bare: DataFrame, other: DataFrame) -> DataFrame:
        if settings.confirm_score < 50:
            return _pairs_on(bare, other, ["name"])
        families = lambda side: side.select("name", "family").distinct()
        differ = families(bare).alias("p").join(_many(families(other).alias("q")), (F.col("p.name") == F.col("q.name")) & (F.col("p.family") != F.col("q.family")))
        differ = differ.select("p.name", F.col("p.family").alias("family"), F.col("q.family").alias("other_family"))
        split = bare.select("id", "name", "family").join(_many(differ), ["name", "family"]).select("id", "name", F.col("other_family").alias("family"))
        return _pairs_on(bare.where("marked"), other, ["name"]).unionByName(_pairs_on(bare, other.where("marked"), ["name"])).unionByName(_pairs_on(split, other, ["name", "family"]))

    found.append(_both_ways(named(x), named(y), within, same_name))
    near = (F.col("x.sim") == F.col("y.sim")) | (F.levenshtein(F.col("x.sim"), F.col("y.sim"), 2) >= 0)
    found.append(_both_ways(x, y, within, lambda bare, other: _pairs_on(_segments(bare, probe=True), _segments(other), ["key", "segment"], near)))
    return reduce(DataFrame.unionByName, found)


def candidate_pairs(a: DataFrame, b: DataFrame | None = None, mode: str = "lossless", settings: Settings = Settings(), max_key_fanout: int | None = None) -> DataFrame:  # J09
    """Pairs (id_a, id_b, a, b) of prepared books; within ``a`` if b is None.

    lossless: equi-joins on keys that every pair which ``scored`` lets pass shares (``_lossless_ids``). reference: equi-joins
    on ``blocking_keys``. exhaustive: every pair, for small books and tests.
    An email or phone that very many records share gives all their pairs, since each of them scores, dealt in blocks
    (``pairs_by_key``). With ``max_key_fanout`` (an argument or a setting) the records of such a key (``hot_keys`` lists them) are paired with the least of them alone: pairs get fewer, and clusters of
    pairs (O22) stay whole as far as those pairs pass.
    """
    within = b is None
    b = a if within else b
    order = F.col("x.id") < F.col("y.id") if within else F.lit(True)
    if mode == "exhaustive":
        pairs = a.alias("x").join(b.alias("y"), order)
        return pairs.select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), F.struct("x.c", "x.n", "x.extra", "x.sim").alias("a"), F.struct("y.c", "y.n", "y.extra", "y.sim").alias("b"))
    if mode == "reference":
        keys = lambda side: side.select("id", F.explode(C.blocking_keys(F.col("c"))).alias("key"))
        ids = _pairs_on(keys(a), keys(b), ["key"], order).distinct()
    else:
        ids = _lossless_ids(a, b, within, settings, max_key_fanout or settings.max_key_fanout)
    ids = durable(ids)
    left = a.select(F.col("id").alias("id_a"), F.struct("c", "n", "extra", "sim").alias("a"))
    right = b.select(F.col("id").alias("id_b"), F.struct("c", "n", "extra", "sim").alias("b"))
    return ids.join(_many(left), "id_a").join(_many(right), "id_b").select("id_a", "id_b", "a", "b")


def _segments(side: DataFrame, probe: bool = False) -> DataFrame:
    """(id, sim, key, segment): organisation and address, each with segments of the name: two strings within two edits share a third part.

    A name of length L is cut in three (lengths by L); a partner of length L-2 .. L+2 holds one of
    the parts, shifted by two at most, so the probing side gives all substrings that could be that part.
    """
    one = lambda tag, v: F.when(v != "", F.concat(F.lit(tag), v))
    base = side.where("sim <> ''").select("id", "sim", F.explode(F.array_compact(F.array(one("O:", F.col("org")), one("A:", F.col("place"))))).alias("key"))
    cut = lambda length, k: (length * k / 3).cast("int")
    part = lambda length, k, s: F.concat_ws("|", length.cast("string"), k.cast("string"), F.substring(F.col("sim"), F.greatest(cut(length, k) + 1 + s, F.lit(1)), cut(length, k + 1) - cut(length, k)))
    thirds, near = F.sequence(F.lit(0), F.lit(2)), F.sequence(F.lit(-2), F.lit(2))
    length = F.length("sim")
    if not probe:
        parts = F.transform(thirds, lambda k: part(length, k, F.lit(0)))
    else:
        parts = F.array_distinct(F.flatten(F.transform(thirds, lambda k: F.flatten(F.transform(near, lambda d: F.transform(near, lambda s: part(length + d, k, s)))))))
    return base.select("id", "sim", "key", F.explode(parts).alias("segment"))


def match_score(a: Column, b: Column) -> Column:  # O09
    """Struct of the eight components for two prepared records (structs with ``n``)."""
    x, y = a["n"], b["n"]
    email, phone = X.overlaps(x["emails"], y["emails"]), X.overlaps(x["phones"], y["phones"])
    exact = (x["full_name"] != "") & (x["full_name"] == y["full_name"])
    similar = ~exact & (a["sim"] != "") & (b["sim"] != "") & (F.levenshtein(a["sim"], b["sim"], 2) >= 0)
    same = lambda f: (x[f] != "") & (x[f] == y[f])
    named = exact | similar
    mismatch = named & N.domains_conflict(x["emails"], y["emails"])
    different = named & ~email & ~phone & C.has_contact(x) & C.has_contact(y)
    tests = {"email": email, "phone": phone, "exact_name": exact, "similar_name": similar, "organization": same("organization"), "address": same("address"), "domain_mismatch": mismatch, "different_info": different}
    return F.struct(*(F.when(t, F.lit(POINTS[k])).otherwise(F.lit(0)).alias(k) for k, t in tests.items()))


def total_score(parts: Column) -> Column:  # A10
    return F.greatest(F.lit(0), sum((parts[k] for k in POINTS), F.lit(0)))


def total_with_bonus(parts: Column, bonus: Column) -> Column:
    return F.least(F.lit(100), total_score(parts) + bonus)


def reasons(parts: Column) -> Column:  # O10
    return F.array_compact(F.array(*(F.when(parts[k] != 0, F.lit(text)) for k, text in REASONS)))


def primary_reason(parts: Column) -> Column:
    return F.coalesce(F.get(reasons(parts), F.lit(0)), F.lit("Similar contacts"))


def nlp_signals(a: Column, b: Column) -> Column:  # O11
    """array<struct<label,weight>> of the signals that hold; labels and weights are fixed values."""
    x, y, e, f = a["n"], b["n"], a["extra"], b["extra"]
    family = (x["family_name"] != "") & (x["family_name"] == y["family_name"])
    first = lambda n: F.get(F.split(n["given_name"], " "), F.lit(0))
    nick = (first(x) != "") & (first(y) != "") & (first(x) != first(y)) & (e["nickname_group"] == f["nickname_group"])
    gx, gy = x["given_name"], y["given_name"]
    initial = (gx != "") & (gy != "") & F.when(F.length(gx) == 1, F.startswith(gy, gx)).when(F.length(gy) == 1, F.startswith(gx, gy)).otherwise(F.lit(False))
    phonetic = (e["soundex"] != "") & (e["soundex"] == f["soundex"]) & (x["family_name"] != y["family_name"])
    tight = lambda n: F.replace(n["full_name"], F.lit(" "), F.lit(""))
    compound = (tight(x) != "") & (x["full_name"] != y["full_name"]) & (tight(x) == tight(y))
    stored = lambda own, other: (own["nickname"] != "") & F.startswith(other["given_name"], own["nickname"])
    found = [
        ("Nickname / common name variant", nick, F.when(family, 35.0).otherwise(20.0)),
        ("First-name initial matches full name", initial, F.when(family, 25.0).otherwise(10.0)),
        ("Name components match when reordered", X.same_tokens(x["full_name"], y["full_name"]), F.lit(20.0)),
        ("Surnames sound similar (phonetic match)", phonetic, F.lit(10.0)),
        ("Phone numbers share last 7 digits", X.any_pair(e["digits"], f["digits"], N.phone_suffix_equal), F.lit(30.0)),
        ("Emails appear to be plus-aliases of each other", X.any_pair(e["emails"], f["emails"], N.email_aliases), F.lit(40.0)),
        ("Possible compound / split name format", compound, F.lit(25.0)),
        ("Contact's stored nickname matches other name", stored(e, y), F.lit(20.0)),
        ("Contact's stored nickname matches other name", stored(f, x), F.lit(20.0)),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(label).alias("label"), weight.alias("weight"))) for label, test, weight in found)))


def signal_delta(signals: Column) -> Column:  # A15
    return F.aggregate(signals, F.lit(0.0), lambda total, s: total + s["weight"])


def suggested(score: Column) -> Column:  # P56
    return F.when(score >= 80, "merge").when(score >= 50, "skip").otherwise("keepSeparate")


def verdict(score: Column, why: Column, signals: Column) -> Column:  # O12
    final = F.least(F.lit(100.0), score + signal_delta(signals))
    said = F.concat(why, F.transform(signals, lambda s: s["label"]))
    fallback = F.when(final >= 50, "Contacts appear similar based on available data.").otherwise("Contacts appear to be different people.")
    return F.struct((final / 100).alias("confidence"), (final >= 50).alias("is_duplicate"), F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise(fallback).alias("reasoning"), suggested(final).alias("action"))


def scored(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Candidate pairs with score, reasons, signals and verdict; those under the pre-filter or the confirm score go."""
    least = max(30, settings.confirm_score - 20) if settings.ai_matching else settings.confirm_score
    df = pairs.withColumn("parts", match_score(F.col("a"), F.col("b"))).withColumn("score", total_score(F.col("parts"))).where(F.col("score") >= least)
    df = df.withColumn("signals", nlp_signals(F.col("a"), F.col("b")) if settings.ai_matching else F.array().cast("array<struct<label:string,weight:double>>"))
    df = df.withColumn("verdict", verdict(F.col("score"), reasons(F.col("parts")), F.col("signals")))
    confidence = (F.round(F.col("verdict.confidence") * 100, 6)).cast("int")
    return df.withColumn("effective", F.least(F.lit(100), confidence)).where(F.col("effective") >= settings.confirm_score)


_FOUND = ["parts", "score", "signals", "verdict", "effective"]
Carry = Callable[[Column], Column]


def bare_ids(c: Column) -> Column:
    """A ``carry`` for callers that need no more of the records than their ids."""
    return F.lit(True)


def _kept(carry: Carry | None) -> Column:
    return (F.struct("c", "n", "extra", "sim") if carry is None else carry(F.col("c"))).alias("kept")


def _profiled(side: DataFrame, carry: Carry | None) -> DataFrame:
    """(id, profile, traits, keys, kept) of prepared records, written once: the steps read it several times, and prepared records are wide.

    ``traits`` is all that the score of a pair reads of a record if the two share none of the ``keys`` (hashes of emails,
    phones and alias keys); ``profile`` is its SHA-256, ``kept`` what goes along with an id.
    """
    n, e = F.col("n"), F.col("extra")
    domains = F.array_sort(F.array_distinct(F.array_compact(F.transform(n["emails"], N.email_domain))))
    traits = F.struct(n["full_name"].alias("full_name"), n["given_name"].alias("given_name"), n["family_name"].alias("family_name"), n["organization"].alias("organization"), n["address"].alias("address"), "sim", domains.alias("domains"), (~C.has_contact(n)).alias("bare"), e["nickname_group"].alias("nickname_group"), e["soundex"].alias("soundex"), e["nickname"].alias("nickname"))
    tagged = lambda tag, v: F.transform(v, lambda x: F.concat(F.lit(tag), x))
    keys = F.concat(tagged("E:", n["emails"]), tagged("P:", n["phones"]), _alias_list())
    rows = side.where("id is not null").select("id", traits.alias("traits"), F.array_distinct(F.transform(F.array_compact(keys), lambda k: F.xxhash64(k))).alias("keys"), _kept(carry))
    return durable(rows.withColumn("profile", F.sha2(F.to_json("traits"), 256)))


def _as_records(profiles: DataFrame, role: str) -> DataFrame:
    """Profiles as prepared records, id being the profile; their emails and phones are made up for a role, so those of two roles never agree."""
    t, none = F.col("traits"), F.array().cast("array<string>")
    same = lambda *names: [t[f].alias(f) for f in names]
    mails = F.transform(t["domains"], lambda d: F.concat(F.lit(f"{role}@"), d))
    n = F.struct(*same("full_name", "given_name", "family_name", "organization", "address"), mails.alias("emails"), F.when(t["bare"], none).otherwise(F.array(F.lit(role))).alias("phones"))
    extra = F.struct(*same("nickname_group", "soundex", "nickname"), none.alias("digits"), none.alias("emails"))
    return profiles.select(F.col("profile").alias("id"), "of", n.alias("n"), extra.alias("extra"), t["sim"].alias("sim"))


def _passing_profiles(x: DataFrame, y: DataFrame | None, settings: Settings) -> DataFrame:
    """(pair, p_a, p_b, n_a, n_b, score ...): pairs of profiles whose records pass ``scored`` together, with their numbers of records; within x if y is None.

    The score does not depend on which of the two comes first.
    """
    within = y is None
    counted = lambda side: durable(side.groupBy("profile", "traits").agg(F.count("*").alias("of")))
    px = counted(x)
    a, b = _as_records(px, "a"), _as_records(px if within else counted(y), "b")
    ids = _ids_without_contact(a, b, within, settings)
    if within:
        one = a.where("of > 1 and n.full_name <> ''").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
        ids = ids.unionByName(one)
    side = lambda rows, r: rows.select(F.col("id").alias(f"id_{r}"), F.col("of").alias(f"n_{r}"), F.struct("n", "extra", "sim").alias(r))
    found = scored(ids.distinct().join(_many(side(a, "a")), "id_a").join(_many(side(b, "b")), "id_b"), settings)
    return durable(found.select(F.monotonically_increasing_id().alias("pair"), F.col("id_a").alias("p_a"), F.col("id_b").alias("p_b"), "n_a", "n_b", *_FOUND))


#: Pairs of profiles up to which they are broadcast to the records, so that those of a large profile stay where they are.
MOST_BROADCAST = 10_000


def _expanded(passing: DataFrame, x: DataFrame, y: DataFrame | None) -> DataFrame:
    """The pairs of records of passing profiles, but those that share a key (or are mapped: x.mapped).

    Large profiles are dealt in blocks by their ids' hash, and each pair of blocks is a join key of its own; a pair of
    records is made where it is given out and moves no more.
    """
    within = y is None
    y = x if within else y
    rows, total = passing.agg(F.count("*"), F.sum(F.col("n_a") * F.col("n_b"))).first()
    parts = _tasks(passing.sparkSession, int(total or 0))
    met = F.broadcast if rows <= MOST_BROADCAST else _many
    one = (F.col("p_a") == F.col("p_b")) if within else F.lit(False)
    of = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    known = passing.select("*", one.alias("one"), of("n_a").alias("of_a"), of("n_b").alias("of_b"))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    mapped = [F.col("mapped")] if "mapped" in x.columns else []
    left = x.join(met(known.withColumnRenamed("p_a", "profile")), "profile").select("pair", at("of_a").alias("at_a"), "of_b", "one", "id", "keys", "kept", *mapped, *_FOUND)
    left = left.withColumn("at_b", F.explode(F.sequence(F.when(F.col("one"), F.col("at_a")).otherwise(0), F.col("of_b") - 1)))
    right = y.join(met(known.withColumnRenamed("p_b", "profile").select("profile", "pair", "of_a", "of_b", "one")), "profile").select("pair", at("of_b").alias("at_b"), "of_a", "one", "id", "keys", "kept")
    right = right.withColumn("at_a", F.explode(F.sequence(F.lit(0), F.when(F.col("one"), F.col("at_b")).otherwise(F.col("of_a") - 1))))
    key = ["pair", "at_a", "at_b"]
    left, right = left.repartition(parts, *key).alias("x"), _many(right.repartition(parts, *key).alias("y"))
    on = ~F.arrays_overlap("x.keys", "y.keys") & (~F.col("x.one") | (F.col("x.at_a") < F.col("x.at_b")) | (F.col("x.id") < F.col("y.id")))
    for k in key:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    if within:
        on = on & (F.col("x.id") != F.col("y.id"))
    if mapped:
        on = on & (F.col("x.mapped").isNull() | (F.col("x.mapped") != F.col("y.id")))
    both = left.join(right, on)
    i, j, a, b = F.col("x.id"), F.col("y.id"), F.col("x.kept"), F.col("y.kept")
    turned = [F.least(i, j).alias("id_a"), F.greatest(i, j).alias("id_b"), F.when(i < j, a).otherwise(b).alias("a"), F.when(i < j, b).otherwise(a).alias("b")]
    return both.select(*(turned if within else [i.alias("id_a"), j.alias("id_b"), a.alias("a"), b.alias("b")]), *(F.col(f"x.{f}") for f in _FOUND))


def _by_contact(a: DataFrame, b: DataFrame | None, x: DataFrame, y: DataFrame | None, settings: Settings, carry: Carry | None, last: DataFrame | None = None) -> DataFrame:
    """The pairs that share a key, each scored by itself; a and b are prepared records, x and y their profiled rows."""
    keys = lambda side: side.select("id", F.explode("keys").alias("key"))
    ids = pairs_by_key(keys(x), None if y is None else keys(y)).distinct()
    if last is not None:
        ids = ids.join(_many(last), ["id_a", "id_b"], "left_anti")
    side = lambda rows, r: rows.select(F.col("id").alias(f"id_{r}"), F.struct("n", "extra", "sim").alias(r), _kept(carry).alias(f"kept_{r}"))
    pairs = durable(ids).join(_many(side(a, "a")), "id_a").join(_many(side(a if b is None else b, "b")), "id_b")
    return scored(pairs, settings).select("id_a", "id_b", F.col("kept_a").alias("a"), F.col("kept_b").alias("b"), *_FOUND)


def _carried(pairs: DataFrame, carry: Carry | None) -> DataFrame:
    return pairs if carry is None else pairs.withColumns({s: carry(F.col(f"{s}.c")) for s in ("a", "b")})


def detect_within(book: DataFrame, settings: Settings = Settings(), mode: str = "lossless", group_type: str = "withinGoogle", carry: Carry | None = None) -> DataFrame:  # O13
    """Duplicate pairs of a book with score, signals and verdict. a and b are the prepared records, or what ``carry`` makes of a contact.

    Pairs that share an email, phone or alias are scored one by one; all others by their profiles (``_profiled``), so candidates
    that fail are never made and the records of a pair are not joined to it.
    """
    ready = prepared(book, settings.nicknames)
    if mode != "lossless" or settings.max_key_fanout:
        found = _carried(scored(candidate_pairs(ready, mode=mode, settings=settings), settings), carry)
    else:
        x = _profiled(ready, carry)
        found = _by_contact(ready, None, x, None, settings, carry).unionByName(_expanded(_passing_profiles(x, None, settings), x, None))
    return found.withColumn("type", F.lit(group_type))


def duplicate_clusters(book: DataFrame, settings: Settings = Settings()) -> DataFrame:  # O22
    """(id, cluster) over the pairs of ``detect_within``, without making those of profiles.

    All records of two profiles that pass are joined by their least ids: a pair of theirs that shares a key has more points and signals
    than its profiles, so it passes too.
    """
    if settings.max_key_fanout:
        return clusters(detect_within(book, settings).select("id_a", "id_b"))
    ready = prepared(book, settings.nicknames)
    x = _profiled(ready, bare_ids)
    passing = _passing_profiles(x, None, settings)
    some = passing.select(F.explode(F.array("p_a", "p_b")).alias("profile")).distinct()
    members = durable(x.join(some, "profile").select("profile", "id"))
    hubs = durable(members.groupBy("profile").agg(F.min("id").alias("hub")))
    spokes = members.join(hubs, "profile").where("id <> hub").select(F.col("hub").alias("id_a"), F.col("id").alias("id_b"))
    ways = passing.where("p_a <> p_b").join(hubs.toDF("p_a", "id_a"), "p_a").join(hubs.toDF("p_b", "id_b"), "p_b").select("id_a", "id_b")
    return clusters(_by_contact(ready, None, x, None, settings, bare_ids).select("id_a", "id_b").unionByName(spokes).unionByName(ways))


def last_mapped(mapping: DataFrame) -> DataFrame:
    """(id_a, id_b): the last mapping of each left id."""
    last = F.max("mac_contact_identifier") if "seq" not in mapping.columns else F.max_by("mac_contact_identifier", "seq")
    return mapping.groupBy("google_resource_name").agg(last.alias("mac_contact_identifier")).toDF("id_a", "id_b")


def drop_mapped(pairs: DataFrame, mapping: DataFrame) -> DataFrame:  # J08
    """Pairs without those that the last mapping of a left id joins."""
    return pairs.join(_many(last_mapped(mapping)), ["id_a", "id_b"], "left_anti")


def detect_across(left: DataFrame, right: DataFrame, mapping: DataFrame, settings: Settings = Settings(), mode: str = "lossless", carry: Carry | None = None) -> DataFrame:  # O14
    """Duplicate pairs across two books, without mapped ones; as ``detect_within``."""
    a, b = prepared(left, settings.nicknames), prepared(right, settings.nicknames)
    if mode != "lossless" or settings.max_key_fanout:
        found = _carried(scored(drop_mapped(candidate_pairs(a, b, mode, settings), mapping), settings), carry)
    else:
        last = durable(last_mapped(mapping))
        x, y = _profiled(a, carry), _profiled(b, carry)
        known = x.join(_many(last.toDF("id", "mapped")), "id", "left")
        found = _by_contact(a, b, x, y, settings, carry, last).unionByName(_expanded(_passing_profiles(x, y, settings), known, y))
    return found.withColumn("type", F.lit("crossSource"))


def detect_duplicates(left: DataFrame, right: DataFrame, mapping: DataFrame, settings: Settings = Settings(), decisions: DataFrame | None = None, carry: Carry | None = None) -> DataFrame:  # O15, X01
    found = union_pairs(detect_within(left, settings, carry=carry), detect_within(right, settings, group_type="withinMac", carry=carry), detect_across(left, right, mapping, settings, carry=carry))
    found = found.withColumn("pattern", pattern_text(F.col("type"), F.col("effective"), primary_reason(F.col("parts"))))
    return apply_patterns(found, decisions) if decisions is not None else found.withColumn("decision", F.lit(None).cast("string"))


def union_pairs(*pairs: DataFrame) -> DataFrame:  # X01
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def pattern_text(kind: Column, score: Column, reason: Column, n: int = 2) -> Column:  # P57
    return F.concat(F.lit("type:"), kind, F.lit("|score:"), (F.floor(score / 10) * 10).cast("int").cast("string"), F.lit("|reason:"), reason, F.lit(f"|count:{n}"))


def apply_patterns(pairs: DataFrame, decisions: DataFrame) -> DataFrame:  # J12
    """The latest remembered decision of a pair's pattern."""
    latest = decisions.groupBy("pattern").agg(F.max_by("decision", "created_at").alias("decision"))
    return pairs.join(latest, "pattern", "left")


def suppress_pairs(pairs: DataFrame, kept: DataFrame) -> DataFrame:  # J13
    """Pairs whose key is not among the kept-separate ones (column pair_key). Keys are made where they are compared, so pairs move without them.

    Ids begin alike, so that sorting keys as texts is slow: they are sorted by a hash first.
    """
    key, other = N.pair_key(F.col("id_a"), F.col("id_b")), F.col("__kept")
    same = (F.xxhash64(key) == F.xxhash64(other)) & (key == other)
    return pairs.join(_many(kept.select(F.col("pair_key").alias("__kept"))), same, "left_anti").withColumn("pair_key", key)


def routing(score: Column, decision: Column, n: int = 2, settings: Settings = Settings()) -> Column:  # P58
    auto = (score >= settings.auto_score) & F.lit(n <= settings.max_auto_group)
    prompt = score.between(settings.confirm_score, settings.auto_score - 1)
    return F.struct(auto.alias("auto"), prompt.alias("prompt"), (score < settings.confirm_score).alias("separate"), (prompt | (auto & decision.isNull())).alias("needs_confirmation"))


def merge_conflicts(a, b) -> Column:  # A12, O17
    """struct: whether given name, family name, organisation conflict, and the total of emails and phones."""
    distinct = lambda f: F.size(F.array_distinct(F.filter(F.array(a[f], b[f]), lambda v: v.isNotNull() & (v != ""))))
    total = lambda f: F.coalesce(F.size(a[f]), F.lit(0)) + F.coalesce(F.size(b[f]), F.lit(0))
    return F.struct((distinct("given_name") > 1).alias("given"), (distinct("family_name") > 1).alias("family"), (distinct("organization") > 1).alias("organization"), total("emails").alias("emails"), total("phones").alias("phones"))


def safe_to_merge(score: Column, conflicts: Column, n: int = 2, settings: Settings = Settings()) -> Column:  # O16
    return (score >= settings.auto_score) & F.lit(n <= settings.max_auto_group) & ~(conflicts["given"] | conflicts["family"] | conflicts["organization"])


def bulk_decide(pairs: DataFrame, decision: str) -> DataFrame:  # O24
    return pairs.withColumn("decision", F.coalesce("decision", F.lit(decision)))


def may_proceed(pairs: DataFrame) -> DataFrame:  # O41
    asked = routing(F.col("effective"), F.col("decision"))["needs_confirmation"] & F.col("decision").isNull()
    return pairs.agg((~F.coalesce(F.bool_or(asked), F.lit(False))).alias("may_proceed"))


def dedup_stats(pairs: DataFrame, scanned: int | Column) -> DataFrame:  # A05
    r = routing(F.col("effective"), F.col("decision"))
    return pairs.agg(F.lit(scanned).cast("long").alias("scanned") if not isinstance(scanned, Column) else scanned, F.count("*").alias("groups"), F.count_if(r["auto"]).alias("auto"), F.count_if(r["prompt"]).alias("confirm"), F.count_if(r["separate"]).alias("separate"))


def in_band(score: Column, settings: Settings = Settings()) -> Column:  # P55
    return score.between(settings.score_low, settings.score_high)


def review_card(c, most: int = 200) -> Column:  # P59
    """One line of a record for an adjudicator."""
    one = lambda label, v: F.when(N.non_blank(v).isNotNull(), F.concat(F.lit(f"{label}: "), N.bounded_single_line(v, most)))
    return F.concat_ws(" | ", one("Name", C.display_name(c)), one("Org", c["organization"]), one("Title", c["job_title"]), one("Emails", F.array_join(C.values(c["emails"]), ", ")), one("Phones", F.array_join(C.values(c["phones"]), ", ")), one("Nickname", c["nickname"]))


def review_form(c: Column) -> Column:
    """What a review needs of a record: its fingerprint and its card; a ``carry`` of the detectors."""
    print_of = lambda c: N.fingerprint(c["contact_id"], c["given_name"], c["middle_name"], c["family_name"], c["nickname"], c["organization"], F.array_join(C.values(c["emails"]), "\n"), F.array_join(C.values(c["phones"]), "\n"))
    return F.struct(print_of(c).alias("print"), review_card(c).alias("card"))


def review_requests(pairs: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Ambiguous pairs as cards with the key by which a verdict comes back; a and b are prepared records or forms (``review_form``)."""
    band = pairs.where(in_band(F.col("score"), settings))
    a, b = (F.col(s) if "card" in pairs.schema[s].dataType.names else review_form(F.col(f"{s}.c")) for s in ("a", "b"))
    return band.select("id_a", "id_b", N.pair_key(a["print"], b["print"]).alias("verdict_key"), a["card"].alias("card_a"), b["card"].alias("card_b"), *keep)


_VERDICT = "struct<confidence:double,is_duplicate:boolean,reasoning:string,action:string>"


def parse_verdict(text: Column, local: Column) -> Column:  # P60
    """An adjudicator's JSON answer, fences stripped; missing keys fall back to the local verdict."""
    body = N.trimmed(F.regexp_replace(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*", ""), r"(?s)\s*```\s*$", ""))
    v = F.from_json(body, _VERDICT)
    action = F.when(v["action"].isin("merge"), "merge").when(v["action"].isin("keep_separate"), "keepSeparate").otherwise("skip")
    parsed = F.struct(F.coalesce(v["confidence"] / 100, local["confidence"]).alias("confidence"), F.coalesce(v["is_duplicate"], local["is_duplicate"]).alias("is_duplicate"), F.coalesce(N.bounded_single_line(v["reasoning"], 300), local["reasoning"]).alias("reasoning"), action.alias("action"))
    return F.when(v.isNotNull() & F.coalesce(*(v[k].cast("string") for k in ("confidence", "is_duplicate", "reasoning", "action"))).isNotNull(), parsed).otherwise(local)


def with_verdicts(pairs: DataFrame, answers: DataFrame) -> DataFrame:  # J15
    """pairs (verdict_key, verdict) with the answer (verdict_key, answer) where one came."""
    one = answers.groupBy("verdict_key").agg(F.max("answer").alias("answer"))
    joined = pairs.join(one, "verdict_key", "left")
    return joined.withColumn("verdict", F.when(F.col("answer").isNull(), F.col("verdict")).otherwise(parse_verdict(F.col("answer"), F.col("verdict")))).drop("answer")


def simple_keys(book: DataFrame) -> DataFrame:
    """(id, key): the lower given and family name, and each lower email, of a record."""
    rows = C.completed(book).select(F.col("contact_id").alias("id"), F.lower("given_name").alias("g"), F.lower("family_name").alias("f"), F.transform(C.values(F.col("emails")), F.lower).alias("e"))
    by_name = rows.where("g is not null and f is not null").select("id", F.concat_ws("\x1f", F.lit("n"), "g", "f").alias("key"))
    by_mail = rows.select("id", F.explode(F.array_distinct("e")).alias("m")).where("m is not null").select("id", F.concat(F.lit("e\x1f"), "m").alias("key"))
    return by_name.unionByName(by_mail)


def simple_duplicates(book: DataFrame) -> DataFrame:  # J21
    """Pairs with the same lower given and family name, or a shared lower email; a name of very many records is dealt in blocks.

    A pair comes from the first key that both have (names before emails), and moves no more.
    """
    place = lambda k: F.struct(F.startswith(k, F.lit("e")).alias("mail"), k.alias("key"))
    keys = simple_keys(book).distinct()
    every = keys.groupBy("id").agg(F.collect_set("key").alias("keys"))
    return pairs_by_key(durable(keys.join(_many(every), "id").select("id", "key", F.filter("keys", lambda k: place(k) < place(F.col("key"))).alias("before"))))


def simple_duplicate_groups(book: DataFrame) -> DataFrame:  # J21
    """(id, cluster) of the records that ``simple_duplicates`` joins, directly or over others, without its pairs: a star of edges for each key."""
    keys = durable(simple_keys(book))
    stars = keys.join(_many(keys.groupBy("key").agg(F.min("id").alias("hub"))), "key").where("id <> hub").select(F.col("hub").alias("id_a"), F.col("id").alias("id_b"))
    return clusters(stars.distinct())
