"""Secret scans by multipart credential linking, in native expressions only.

Strong findings stand for themselves: assigned secrets, access identifiers, long hex strings. Weak candidates -- account
names, bare 40-character keys, endpoints -- are reported only where the parts that complement them co-occur in their
scope: a bare key or an account name with the other side of a credential, an endpoint with both sides. The parts meet
in an interval join: scopes are cut into blocks, each block keeps the first and last start of each role, and a candidate
meets its own block and the two beside it. So a block gives one row however many parts it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, text_of
from siltstone.llm.spans import masked, match_spans

# The patterns of the findings.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ACCOUNT = r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
BARE_KEY = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i)\b(?:https?|ftp|amqp|redis|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z0-9]+)://[^\x00-\x20"'<>]{4,}"""
#: Kinds in their listed order.
KINDS = ("assign", "access", "hex", "account", "bare_key", "endpoint")
#: Starts of parts of one credential lie at most so many characters apart.
SCOPE = 400


def _kind(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text) and, by kind, the arrays of (s, k, e) of strong findings and weak candidates, of every
    row: a written table, so that each pattern goes over a text once. Weak candidates lie outside of strong findings."""
    text = text_of()
    assign = F.filter(match_spans(text, ASSIGN, 2), lambda x: x["v"] >= 6)
    access = F.filter(match_spans(text, ACCESS), lambda x: x["v"] >= 20)
    rows = docs.select("doc_id", text.alias("text"), _kind(assign, "assign").alias("assign"), _kind(access, "access").alias("access"), _kind(match_spans(text, HEX), "hex").alias("hex"))
    any_base = F.size("assign") + F.size("access") + F.size("hex") > 0
    cover = F.when(any_base, masked(masked(masked(F.col("text"), ASSIGN), ACCESS), HEX)).otherwise(F.col("text"))
    rows = rows.select("doc_id", _key(F.col("text")).alias("h"), "assign", "access", "hex", cover.alias("cover"))
    cover = F.col("cover")
    rows = rows.select(
        "doc_id", "h", "assign", "access", "hex",
        _kind(match_spans(cover, ACCOUNT), "account").alias("account"), _kind(F.filter(match_spans(cover, BARE_KEY), lambda x: x["v"] > 0), "bare_key").alias("bare_key"), _kind(match_spans(cover, ENDPOINT), "endpoint").alias("endpoint"), "cover",
    )
    # a bare key has letters of both cases and digits
    of = lambda x: F.substring(cover, x["s"] + 1, x["e"] - x["s"])
    rows = rows.withColumn("bare_key", F.filter("bare_key", lambda x: of(x).rlike("[a-z]") & of(x).rlike("[A-Z]") & of(x).rlike("[0-9]")))
    return materialise(rows.drop("cover"), "secret-candidates")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, h, weak: the weak candidates of each text that complementary parts stand by. found: as of candidates().

    Repeated rows have the same text and id, and so the same findings; they are one here.
    """
    sides = F.concat("access", "account"), F.concat("assign", "hex", "bare_key")
    rows = found.filter((F.size("account") + F.size("bare_key") + F.size("endpoint") > 0) & (F.size(sides[0]) > 0) & (F.size(sides[1]) > 0))
    parts = rows.select("doc_id", "h", F.explode(F.concat("assign", "access", "hex", "account", "bare_key", "endpoint")).alias("part")).select("doc_id", "h", "part.*").distinct()
    parts = materialise(parts.withColumn("block", F.floor(F.col("s") / scope)), "secret-parts")
    name, secret = F.col("k").isin(1, 3), F.col("k").isin(0, 2, 4)
    firsts = [f(F.when(c, F.col("s"))).alias(f"{n}_{role}") for role, c in (("name", name), ("secret", secret)) for n, f in (("first", F.min), ("last", F.max))]
    blocks = parts.groupBy(F.col("doc_id").alias("b_id"), F.col("h").alias("b_h"), F.col("block").alias("b_block")).agg(*firsts)
    weak = parts.filter("k >= 3").withColumn("near", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    met = weak.join(blocks, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h")) & (F.col("near") == F.col("b_block")))
    side = lambda role: F.coalesce((F.col(f"first_{role}") <= F.col("s") + scope) & (F.col(f"last_{role}") >= F.col("s") - scope), F.lit(False))
    each = met.groupBy("doc_id", "h", "s", "k", "e").agg(F.max(side("name")).alias("name"), F.max(side("secret")).alias("secret"))
    complete = F.when(F.col("k") == 3, F.col("secret")).when(F.col("k") == 4, F.col("name")).otherwise(F.col("name") & F.col("secret"))
    return each.filter(complete).groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "k", "e")).alias("weak"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, h (a hash of the text), and the arrays assign, access, hex and weak of (s, k, e).

    Places are code points, ends exclusive; k is a kind's place in KINDS. Null texts count as empty and have no spans,
    nor do empty ones. Null ids and repeated rows each keep a row. An empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    found = candidates(docs)
    weak = materialise(linked(found), "secret-links").select(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h"), "weak")
    out = found.join(weak, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")), "left")
    return out.select("doc_id", "h", "assign", "access", "hex", F.coalesce("weak", F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")).alias("weak"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak of every document; see secret_spans."""
    base = F.concat("assign", "access", "hex")
    size = lambda c: F.size(c).cast("long")
    return secret_spans(docs).select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, "weak")).alias("spans"), size("weak").alias("n_weak"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs, with every finding in ``text`` replaced by a mark (of an assignment, its value), and ``n_chars``, if there is
    such a column, counted anew. Texts without findings are unchanged and null texts stay null; all rows stay."""
    text = text_of()
    weak = materialise(linked(candidates(docs)), "secret-links").select(F.col("doc_id").alias("_w_id"), F.col("h").alias("_w_h"), F.col("weak").alias("_w"))
    place = lambda spans, s: F.transform(spans, lambda x: F.struct(s(x).alias("s"), x["e"].alias("e")))
    own = F.concat(
        place(F.filter(match_spans(text, ASSIGN, 2), lambda x: x["v"] >= 6), lambda x: x["e"] - x["v"]),
        place(F.filter(match_spans(text, ACCESS), lambda x: x["v"] >= 20), lambda x: x["s"]), place(match_spans(text, HEX), lambda x: x["s"]),
    )
    rows = docs.select(*docs.columns, own.alias("_own"), _key(text).alias("_h"))
    rows = rows.join(weak, F.col("doc_id").eqNullSafe(F.col("_w_id")) & (F.col("_h") == F.col("_w_h")), "left")
    spans = F.array_sort(F.concat("_own", F.coalesce(place(F.col("_w"), lambda x: x["s"]), F.expr("cast(array() as array<struct<s:int,e:int>>)"))))

    def step(acc: Column, x: Column) -> Column:
        more = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        new = F.concat(acc["out"], F.when(x["s"] >= acc["at"], F.concat(more, F.lit(mark))).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), new.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = rows.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
