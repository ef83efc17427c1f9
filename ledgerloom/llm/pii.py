"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns give the seed entities, whole spans. The words before a seed form a lexical pattern; over the
graph of patterns, seeds and identifier-like tokens or digit runs Spark scores both in turn, and patterns of high confidence mark
tokens that no base pattern knows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .native import between, chunks_of, let, running, total

KINDS = ("email", "ip", "card", "phone")
_MARK, _JOIN, _OTHER = "\x01", "\x02", "\x03"
#: What identifiers are overwritten with, by kind; the last is for candidates. Texts have _OUTSIDE for such characters.
_FILL, _UNKNOWN, _OUTSIDE = "\x04\x05\x06\x07\x08", 4, "\x0e"
_WINDOW = 200
_LOCAL = "[A-Za-z0-9._%+-]"
# \G lets a match begin where the one before it ended, inside a run that the look-behind would skip.
# Repeated groups are possessive: Java matches those in a loop and all others by recursion, a frame for each repeat.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = rf"[0-9][0-9{_JOIN}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Digit groups joined by a blank, bracket, dot or hyphen, two at least, from the start to the end of words.
RUN = r"(?<![^\x20\x09-\x0D\x04-\x08])[+(]*+[0-9]++(?:(?:[.-]|\x20?[()]{1,2}\x20?|\x20)[0-9]++)++(?![\p{L}\p{N}])"
_REST = r"[^\x20\x09-\x0D\x04-\x08]"
_PLAIN = r"[^\x20\x09-\x0D\x04-\x080-9@]"
TOKEN = (
    rf"(?<!{_REST})(?:{_PLAIN}*+(?:[0-9]{_PLAIN}*+){{4}}[0-9]{_REST}*+"
    rf"|[^\x20\x09-\x0D\x04-\x08@]++@{_REST}*+)"
)
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NONE = "array<struct<start:long,kind:int,end:long,token:string>>"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """(start, kind, end, token) of all matches in text, which has no \\x01; code points, end exclusive."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def placed(ps: Column) -> Column:
        starts = running(F.transform(ps, lambda x: F.length(x).cast("long")))
        return let(
            starts,
            lambda s: F.transform(
                F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2)),
                lambda i: F.struct(F.get(s, i).alias("start"), F.lit(kind).alias("kind"), F.get(s, i + 1).alias("end"), F.get(ps, i).alias("token")),
            ),
        )

    return let(parts, lambda ps: F.when(F.size(ps) > 2, placed(ps)).otherwise(F.from_json(F.lit("[]"), _NONE)))


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d).cast("long")

    return total(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value)) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans of the base patterns, by start, then kind as in KINDS. Null text has none."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_MARK}{_JOIN}]", _OTHER)

    def found(t: Column) -> Column:
        none = F.from_json(F.lit("[]"), _NONE)
        chained = F.regexp_replace(t, "(?<=[0-9])[ -](?=[0-9])", _JOIN)
        email = F.when(t.contains("@"), matches(t, EMAIL, 0)).otherwise(none)
        ip = F.filter(matches(t, IP, 1), lambda m: m["token"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        card = F.filter(matches(chained, CARD, 2), lambda m: let(_digits(m["token"]), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))))
        phone = F.filter(matches(t, PHONE, 3), lambda m: F.length(_digits(m["token"])).between(9, 15))
        phone = F.when(t.contains("+"), phone).otherwise(none)
        numeric = F.concat(email, ip, card, phone)
        return F.sort_array(F.when(t.rlike("[0-9]"), numeric).otherwise(email))

    return let(clean, found)


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cover(spans: Column) -> Column:
    """(start, kind, end) of the union of sorted spans; a block has the kind of its first span."""

    def blocks(xs: Column, before: Column) -> Column:
        """before: the greatest end before each span."""
        heads = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: F.get(xs, i)["start"] >= F.get(before, i))

        def block(hs: Column, i: Column, k: Column) -> Column:
            head, last = F.get(xs, i), F.coalesce(F.get(hs, k + 1), F.size(xs)) - 1
            end = F.greatest(F.get(before, last), F.get(xs, last)["end"])
            return F.struct(head["start"].alias("start"), head["kind"].alias("kind"), end.alias("end"))

        return let(heads, lambda hs: F.transform(hs, lambda i, k: block(hs, i, k)))

    def union(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda s: s["end"]), F.greatest)
        return F.when(F.size(xs) > 0, let(reach, lambda before: blocks(xs, before))).otherwise(none)

    none = F.from_json(F.lit("[]"), "array<struct<start:long,kind:int,end:long>>")
    return let(spans, union)


def _replaced(text: Column, cover: Column, by: Callable[[Column], Column]) -> Column:
    """text with by(block) in place of each block of cover."""

    def cut(c: Column, parts: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            since = F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
            return F.concat(between(parts, since, s["start"]), by(s))

        tail = between(parts, F.get(c, F.size(c) - 1)["end"], F.length(text).cast("long"))
        return F.concat(F.array_join(F.transform(c, piece), ""), tail)

    changed = lambda c: let(chunks_of(text), lambda parts: cut(c, parts))
    return let(cover, lambda c: F.when(F.size(c) > 0, changed(c)).otherwise(text))


def _masked(text: Column, spans: Column) -> Column:
    """text with every character of a span replaced by that of the span's kind in _FILL; positions stay."""
    return _replaced(text, _cover(spans), lambda s: F.repeat(F.get(F.array(*map(F.lit, _FILL)), s["kind"]), (s["end"] - s["start"]).cast("int")))


def _tokens(docs: DataFrame) -> DataFrame:
    """Seeds and candidates with the patterns before them: _id, _h, start, end, token, before, kind (null unless a seed).

    A seed is a whole span of the base patterns. A candidate overlaps none; it is a run of digit groups or a single
    token, with '@' or five digits at least; punctuation at a token's ends is left out. A token within a run has no
    patterns.
    """
    some = docs.where(F.col("text").rlike("[0-9@]"))
    some = some.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), "text")
    plain = F.regexp_replace("text", f"[{_MARK}-{_FILL[-1]}]", _OUTSIDE)
    cut = _once(some, _b=base_spans(F.col("text")), _t=plain).drop("text")
    cut = _once(cut, _m=_masked(F.col("_t"), F.col("_b")))
    five = lambda m: F.length(_digits(m["token"])) >= 5
    cut = _once(cut, _r=F.filter(matches(F.col("_m"), RUN, _UNKNOWN), five))
    cut = _once(cut, _n=_masked(F.col("_m"), F.col("_r"))).drop("_m")
    cut = _once(cut, _w=matches(F.col("_n"), TOKEN, _UNKNOWN)).where("size(_b) + size(_r) + size(_w) > 0")
    cut = _once(cut, _m=chunks_of(_masked(F.col("_n"), F.col("_w"))), _c=chunks_of(F.col("_t"))).drop("_n", "_t")
    lead = lambda x: F.length(F.regexp_extract(x, r"^[^\p{L}\p{N}+]*+", 0))
    core = lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}+]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    none, no_kind = F.lit(None).cast("array<string>"), F.lit(None).cast("int")

    def row(start: Column, token: Column, kind: Column, before: Column) -> Column:
        columns = {"start": start, "end": start + F.length(token), "token": token, "before": before, "kind": kind.cast("int")}
        return F.struct(*(c.alias(n) for n, c in columns.items()))

    def context(edge: Column) -> Column:
        return _patterns(between(F.col("_m"), F.greatest(edge - _WINDOW, F.lit(0).cast("long")), edge))

    def part(m: Column) -> Column:
        inner = matches(m["token"], TOKEN, _UNKNOWN)
        return F.transform(inner, lambda x: row(m["start"] + x["start"] + lead(x["token"]), core(x["token"]), no_kind, none))

    seeds = F.transform("_b", lambda m: row(m["start"], between(F.col("_c"), m["start"], m["end"]), m["kind"], context(m["start"])))
    runs = F.transform("_r", lambda m: row(m["start"], m["token"], no_kind, context(m["start"])))
    words = F.transform("_w", lambda m: row(m["start"] + lead(m["token"]), core(m["token"]), no_kind, context(m["start"])))
    inside = F.flatten(F.transform("_r", part))
    found = cut.select("_id", "_h", F.explode_outer(F.concat(seeds, runs, words, inside)).alias("t"))
    return found.select("_id", "_h", "t.*").where("length(token) > 0")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row: no filter or projection above takes their expressions in."""
    one = F.explode_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return df.select("*", one.alias("_one")).select("*", "_one.*").drop("_one")


def _patterns(text: Column) -> Column:
    """The last two units of text as one pattern and the last one as another, as far as there are any.

    A unit is a word in lower case, a number, written 0, or an identifier, written as the mark of its kind.
    """
    lower = F.regexp_replace(F.lower(text), r"\p{N}+", "0")
    marked = F.regexp_replace(lower, r"([\x04-\x08])\1*", " $1 ")
    units = F.filter(F.split(marked, r"[^\p{L}0\x04-\x08]+"), lambda u: u != "")
    two = F.slice(F.concat(F.array(F.lit(""), F.lit("")), units), F.lit(-2), F.lit(2))

    def named(u: Column) -> Column:
        both = F.when(F.get(u, F.lit(0)) != "", F.array_join(u, " "))
        last = F.when(F.get(u, F.lit(1)) != "", F.get(u, F.lit(1)))
        return F.filter(F.array(both, last), lambda x: x.isNotNull())

    return let(two, named)


def discovered(docs: DataFrame, min_seeds: int = 5, min_score: float = 0.8) -> DataFrame:
    """_id, _h, extra: spans that confident patterns add, by document id and hash of its text.

    A pattern's score for a kind is the mean score of its distinct tokens, and it counts with min_seeds seeds
    or accepted tokens at least; a token's score is the noisy-or of its patterns' scores, 1 for a seed. Rounds
    repeat until one accepts no new token: scores never fall, so the accepted tokens only grow. Every occurrence
    of an accepted token is a span, whatever comes before it. A pattern is read from the last 200 characters
    before a token; of a longer unit the last characters count.
    """
    found = written(_tokens(docs))
    edges = found.select("token", "kind", F.explode("before").alias("before"))
    graph = written(edges.groupBy("before", "token").agg(F.max("kind").alias("kind")))
    seeds = found.where("kind is not null").select("token", F.col("kind").alias("k"), F.lit(1.0).alias("score")).distinct()
    score, accepted = seeds, -1
    sizes = graph.groupBy("before").agg(F.count("*").alias("n"))
    while True:
        hits = graph.join(score, "token").groupBy("before", "k").agg(F.sum("score").alias("s"), F.count("*").alias("m"))
        trusted = hits.join(sizes, "before").where((F.col("m") >= min_seeds) & (F.col("s") / F.col("n") >= min_score))
        patterns = trusted.select("before", "k", F.least(F.col("s") / F.col("n"), F.lit(0.999)).alias("p"))
        doubt = F.exp(F.sum(F.log(1 - F.col("p"))))
        fresh = graph.where("kind is null").join(patterns, "before").groupBy("token", "k").agg((1 - doubt).alias("score"))
        fresh = written(fresh.where(F.col("score") >= min_score - 1e-9), False)
        score = seeds.unionByName(fresh).groupBy("token", "k").agg(F.max("score").alias("score"))
        now = fresh.count()
        if now == accepted or now == 0:
            break
        accepted = now
    rest = found.where("kind is null")
    best = score.groupBy("token").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))
    known = written(rest.select("token").distinct().join(best, "token"))
    new = rest.join(known, "token").select("_id", "_h", "start", "end", "token", "k").distinct()
    span = F.struct(F.col("start"), F.col("k").cast("int").alias("kind"), F.col("end"), F.col("token"))
    return new.groupBy("_id", "_h").agg(F.sort_array(F.collect_list(span)).alias("extra"))


def personal_spans(docs: DataFrame, *keep: str, **parameters) -> DataFrame:
    """keep columns of docs with `base` and `spans`, arrays of (start, kind, end, token)."""
    extra = discovered(docs, **parameters).withColumnsRenamed({"_id": "_xid", "_h": "_xh"})
    key = (F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"))
    base = docs.select(*keep, *key, base_spans(F.col("text")).alias("base"))
    joined = base.join(extra, (F.col("_h") == F.col("_xh")) & F.col("_id").eqNullSafe(F.col("_xid")), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "extra")))
    return joined.select(*keep, "base", spans.alias("spans"))


def find_personal_data(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of docs(doc_id, text).

    Null text counts as empty: zero counts, the digest of '' and no spans. Repeated rows give equal rows; a null
    doc_id stays null; an empty table gives no rows. Spans of several kinds may overlap; discovered ones never
    overlap a base span. Other columns, whatever their names, are ignored. Texts may be of any length: no pattern
    recurses, and time grows in proportion to the text and its spans.
    """
    found = personal_spans(docs.select("doc_id", "text"), "doc_id", **parameters)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *map(count, range(4)),
        F.sha2(rendered(F.col("base")), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, **parameters) -> DataFrame:
    """docs, all columns, with each span replaced by [KIND]; overlapping spans are replaced together, by the first one's kind.

    n_chars, where docs has it, follows the text. Null texts stay null, empty ones empty. Rows that repeat, or share
    a null doc_id, are redacted each by its own text; an empty table gives no rows; columns may have any names.
    """
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    found = personal_spans(rows, "text", "_row", **parameters)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    some = F.size("spans") > 0
    clean = _replaced(F.col("text"), _cover(F.col("spans")), lambda s: F.get(names, s["kind"]))
    new = found.withColumn("_new", F.when(some, clean).otherwise(F.col("text")))
    kinds = {f.name: f.dataType for f in docs.schema}
    own = {"text": F.col("_new")}
    if "n_chars" in kinds:
        length = F.length("_new").cast("long")
        own["n_chars"] = F.when(some, length).otherwise(F.col("_row.n_chars").cast("long"))
    return new.select(*((own[c] if c in own else F.col(f"_row.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns))
