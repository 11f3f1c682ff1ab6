"""Secret scan with multipart credential linking (operator 10), in native
DataFrame functions only.

Regular expressions find the strong spans (assignments, access identifiers, hex
strings) and weak candidates: names, bare 40-character keys, short assigned
values, endpoints. A weak candidate is reported only where the parts that
complete a credential lie in its scope, with at most SCOPE code points between
the two intervals: a name needs a secret, a bare key or short value needs an
access identifier, an endpoint needs both.

The interval join works on scope-wide bins of each document; an interval lies in
every bin from its start to its end. Two in one bin are always near enough;
else a partner within SCOPE lies in a neighbouring bin, where the largest end
(to the left) and the smallest start (to the right) are enough. A part tells the
bins it lies in and the two beside them, so rows grow with the lengths of the
parts, and a candidate meets one row per bin of its own, however many parts a
document has.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, written

# FIXED: the base patterns and the sizes their matches need.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"      # the same runs as [0-9a-f]+ of 32 or more
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

SHORT_LEAST = 4             # a short assigned value: 4 to 7 characters
IDENT = r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{4,}"""
KEY40 = r"(?<![A-Za-z0-9+/=])(?![0-9a-f]{40}(?![A-Za-z0-9+/=]))[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9][A-Za-z0-9._:@/?&=%-]*"""
SCOPE = 200
#: kind -> (order, role); the first three are reported as they are
KINDS = {"assign": (0, "secret"), "access": (1, "ident"), "hex": (2, "secret"), "ident": (3, "ident"), "key40": (4, "secret"), "short": (5, "secret"), "endpoint": (6, "endpoint")}
BLOCK = 256


def running(lengths: Column) -> Column:
    """Sums of all elements before each one; in blocks, so that the arrays that
    the fold copies stay short."""
    zero = F.array(F.lit(0).cast("long"))

    def fold(x: Column, start: Column) -> Column:
        return F.aggregate(x, start, lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    def of(x: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        blocks = F.transform(cuts, lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))

        def joined(b: Column) -> Column:
            offsets = fold(F.transform(b, lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, y: a + y)), zero)
            return bind(offsets, lambda o: F.flatten(F.transform(b, lambda v, k: F.slice(fold(v, F.array(F.get(o, k))), 1, F.size(v)))))
        return bind(blocks, joined)
    return F.when(F.size(lengths) > 0, bind(lengths, of)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, length of the group),
    in code points. The text between matches gives the places."""
    p = F.lit(pattern)

    def of(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sizes = F.transform(m, lambda x: F.char_length(x).cast("long"))
        before = F.zip_with(F.slice(F.transform(gaps, lambda x: F.char_length(x).cast("long")), 1, F.size(m)), F.concat(F.array(F.lit(0).cast("long")), F.slice(sizes, 1, F.size(m) - 1)), lambda g, s: g + s)
        values = F.regexp_extract_all(text, p, F.lit(value_group)) if value_group else m

        def placed(lengths: Column) -> Column:
            starts = F.zip_with(running(lengths), lengths, lambda a, b: a + b)
            return F.transform(F.arrays_zip(starts.alias("s"), m.alias("m"), values.alias("v")),
                               lambda z: F.struct(z["s"].alias("start"), (z["s"] + F.char_length(z["m"])).alias("end"), F.char_length(z["v"]).alias("value")))
        return bind(before, placed)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:int>>")
    return F.when(text.rlike(pattern), bind(F.regexp_extract_all(text, p, F.lit(0)), of)).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS[kind][0]).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def spans_of(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, text_hash, ``strong`` and ``weak``:
    arrays of (start, rank, end, kind)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        matches(text, ASSIGN, 2).alias("assign"), matches(text, ACCESS).alias("access"), matches(text, HEX).alias("hex"),
                        matches(text, IDENT).alias("ident"), matches(text, KEY40).alias("key40"), matches(text, ENDPOINT).alias("endpoint"))
    strong = F.concat(_spans(F.filter("assign", lambda x: x["value"] >= ASSIGN_LEAST), "assign"),
                      _spans(F.filter("access", lambda x: x["value"] >= ACCESS_LEAST), "access"), _spans(F.col("hex"), "hex"))
    weak = F.concat(_spans(F.col("ident"), "ident"), _spans(F.col("key40"), "key40"),
                    _spans(F.filter("assign", lambda x: (x["value"] < ASSIGN_LEAST) & (x["value"] >= SHORT_LEAST)), "short"), _spans(F.col("endpoint"), "endpoint"))
    return found.select("doc_id", "text_hash", strong.alias("strong"), weak.alias("weak"))


def linked(spans: DataFrame) -> DataFrame:
    """doc_id, text_hash and ``more``: the weak spans whose complement lies in
    scope. Rows that repeat doc_id and text are one document."""
    role = F.create_map(*(F.lit(v) for k, (_, r) in KINDS.items() for v in (k, r)))
    parts = (spans.where(F.size("weak") > 0).select("doc_id", "text_hash", F.explode(F.concat("strong", "weak")).alias("x"))
             .select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("d"), F.col("doc_id").isNull().alias("nameless"), "text_hash", "x.*", role[F.col("x.kind")].alias("role")).distinct())
    key = ["d", "nameless", "text_hash"]
    first, last = F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)
    told = parts.select(*key, "role", "start", "end", first.alias("first"), last.alias("last"), F.explode(F.sequence(first - 1, last + 1)).alias("bin"))
    here, left = F.col("bin").between(F.col("first"), F.col("last")), F.col("bin") > F.col("last")
    near = told.groupBy(*key, "bin").agg(*(F.struct(F.max(F.when(F.col("role") == r, here)).alias("here"), F.max(F.when((F.col("role") == r) & left, F.col("end"))).alias("end"),
                                                    F.min(F.when((F.col("role") == r) & ~left & ~here, F.col("start"))).alias("start")).alias(r) for r in ("ident", "secret", "endpoint")))
    weak = parts.where(F.col("rank") >= 3).withColumn("bin", F.explode(F.sequence(first, last))).join(near, [*key, "bin"])

    def by(r: str) -> Column:
        return F.coalesce(F.col(f"{r}.here"), F.lit(False)) | F.coalesce(F.col("start") - F.col(f"{r}.end") <= SCOPE, F.lit(False)) | F.coalesce(F.col(f"{r}.start") - F.col("end") <= SCOPE, F.lit(False))
    fits = F.when(F.col("role") == "ident", by("secret")).when(F.col("role") == "secret", by("ident")).otherwise(by("ident"))
    # an endpoint's two partners may lie in different bins of a long endpoint
    met = weak.groupBy(*key, "role", "start", "rank", "end", "kind").agg(F.max(fits).alias("fits"), F.max(by("secret")).alias("secret_too"))
    return (met.where(F.col("fits") & ((F.col("role") != "endpoint") | F.col("secret_too"))).groupBy(*key).agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("more"))
            .select(F.when(~F.col("nameless"), F.col("d")).alias("doc_id"), "text_hash", "more"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row.

    Spans read kind:start:end (code points, end exclusive), by start and then
    kind; ``base_sha256`` digests the strong ones, ``spans`` adds the linked
    weak ones. A null text counts as empty; a null doc_id stays null; an empty
    table gives none.
    """
    spans = written(spans_of(docs.select("doc_id", "text")), "secret-spans")
    more = linked(spans).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "more")
    out = spans.join(more, spans["doc_id"].eqNullSafe(F.col("_d")) & (spans["text_hash"] == F.col("_t")), "left")

    def count(kind: str) -> Column:
        return F.size(F.filter("strong", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    both = F.concat(F.col("strong"), F.coalesce("more", F.slice("strong", 1, 0)))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_text(F.col("strong")), 256).alias("base_sha256"), _text(both).alias("spans"))
