"""Secret scans: regular expressions for strong spans, interval links for weak ones. DataFrame operations only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, group that holds the value, least length of the value), in reporting order.
BASE = {
    "assign": (rf"(?i)(password|passwd|secret|token|api_?key){VALUE}", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs of 24 or more are all that [0-9a-f]+ keeps
}
#: Weak candidates: alone they are no finding. Every run of characters is bounded or starts at a word's edge, so that no text takes long.
WEAK = {
    "ident": (r"(?i)\b(user|username|login|account|client_?id|key_?id|e-?mail)" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)""", 2, 2),
    "email": (r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", 0, 6),
    "key": (rf"(?i)\b(pwd|pass|passphrase|private_?key|auth|bearer|credentials?){VALUE}", 2, 4),
    "run": (
        r"(?<![0-9A-Za-z+/])(?:(?=[0-9]{0,22}[a-f])(?=[a-f]{0,22}[0-9])[0-9a-f]{12,23}|(?=[A-Za-z+/]{0,63}[0-9])(?=[A-Z0-9+/]{0,63}[a-z])(?=[a-z0-9+/]{0,63}[A-Z])[A-Za-z0-9+/]{16,64}={0,2})(?![0-9A-Za-z+/])",
        0,
        12,
    ),
    "endpoint": (r"""(?i)\b(https?|jdbc:[a-z]+|postgres|mysql|redis|mongodb|s3|ftp)://[^\s"'<>]+""", 0, 8),
    "address": (r"(?<![\w.@/-])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?:[a-z0-9-]{1,63}\.){1,8}(?:com|org|net|io|dev|cloud|internal|local))(?![\w-]|\.\w)", 0, 4),
}
#: The role of each kind, and the roles that complete it: a secret needs an identifier or endpoint, those need a secret.
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "run": "secret", "access": "name", "ident": "name", "email": "name", "endpoint": "place", "address": "place"}
COMPLETES = {"secret": ("name", "place"), "name": ("secret",), "place": ("secret",)}
#: Code points between the starts of two parts of one scope, at most.
SCOPE = 200

SPAN = "struct<start:int,ord:int,kind:string,end:int>"
PIECE = "struct<ord:int,i:int,gap:int,hit:int,ok:boolean>"

SIGN = "contains(t, ':') or contains(t, '=')"
#: What a text (column t) must hold for a kind to match at all: quick tests, so that the patterns read few texts.
NEEDS = {
    "assign": SIGN,
    "access": "contains(t, 'AKIA')",
    "hex": "true",
    "ident": SIGN,
    "email": "contains(t, '@')",
    "key": SIGN,
    "run": "t rlike '[0-9]'",
    "endpoint": "contains(t, '://')",
    "address": "t rlike '[0-9A-Za-z-][.][0-9a-z]'",
}


def hits(kind: str, pattern: str) -> Column:
    """All non-overlapping matches in column ``t``."""
    return F.when(F.expr(NEEDS[kind]), F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pieces(kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Length of each match (column ``kind``), of the text between it and the one before, and whether its value is long enough.

    The texts between matches are bound once; within the inner lambda a split would run again for each match.
    """

    def measured(gaps: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            value = F.regexp_extract(hit, pattern, group) if group else hit
            return F.struct(F.lit(order).alias("ord"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(hit).alias("hit"), (F.length(value) >= least).alias("ok"))

        return F.transform(kind, one)

    found = F.get(F.transform(F.array(F.split("t", pattern, -1)), measured), F.lit(0))
    return F.when(F.size(kind) > 0, found).otherwise(F.array().cast(f"array<{PIECE}>"))


def _joined(col: Column) -> Column:
    parts = F.transform(F.array_sort(col), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, links.

    Strong (base) spans are always reported. Weak parts (identifiers, mail addresses, short keys and
    runs, endpoints, addresses) are reported only where a complementary part starts within ``scope``
    code points. An interval join finds these: parts lie in cells of ``scope`` code points of their
    row and meet those of the same and the neighbouring cells; as the matches of a kind don't overlap, a
    part has few others in reach, however long the text is. ``links`` names them, the weak part first
    (kind:start>kind:start, by place). Weak parts that overlap a base span go. Spans are whole matches
    in code points, end exclusive. Null texts are empty; rows with no finding have empty strings for
    spans and links; repeated rows and null ids each give a row; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    kinds = BASE | WEAK
    rows = rows.select("id", "t", *[hits(k, spec[0]).alias(k) for k, spec in kinds.items()])
    found = [pieces(k, i, *spec) for i, (k, spec) in enumerate(kinds.items())]
    rows = stage(rows.select(F.monotonically_increasing_id().alias("rid"), "id", F.concat(*found).alias("pieces")))
    plain, rest = (rows.where(c).select("rid", "id") for c in ("size(pieces) = 0", "size(pieces) > 0"))
    # places are sums of the lengths before: a window over a kind's matches, so that a text takes time in line with its matches
    parts = rows.where("size(pieces) > 0").select("rid", F.explode("pieces").alias("s")).select("rid", "s.*").repartition("rid")
    so_far = Window.partitionBy("rid", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(so_far).cast("int")).where("ok")
    names = F.array(*map(F.lit, kinds))
    parts = parts.select("rid", (F.col("end") - F.col("hit")).alias("start"), "ord", F.get(names, F.col("ord")).alias("kind"), "end")
    before = Window.partitionBy("rid").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the rows after, in falling order: a frame that ends at the last row would be gone through anew for each row
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("ord")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strong = F.col("ord") < len(BASE)
    parts = parts.select(
        "*",
        F.max(F.when(strong, F.col("end"))).over(before).alias("base_end"),
        F.min(F.when(strong, F.col("start"))).over(after).alias("base_start"),
    )
    apart = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce("base_start", F.lit(1 << 30)) >= F.col("end"))
    role = reduce(lambda c, k: F.when(F.col("kind") == k, ROLE[k]).otherwise(c), ROLE, F.lit(None).cast("string"))
    parts = stage(parts.select("rid", "start", "ord", "kind", "end", role.alias("role"), strong.alias("strong"), apart.alias("apart")).where("strong or apart"))
    cell = F.floor(F.col("start") / scope)
    one = parts.where("not strong").select("rid", F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"), *[F.col(c).alias(f"w_{c}") for c in ("start", "ord", "kind", "end", "role")])
    other = parts.select("rid", cell.alias("cell"), *[F.col(c).alias(f"p_{c}") for c in ("start", "ord", "kind", "role")])
    fits = reduce(or_, ((F.col("w_role") == r) & F.col("p_role").isin(*needs) for r, needs in COMPLETES.items()))
    pairs = one.join(other, ["rid", "cell"]).where(fits & (F.abs(F.col("w_start") - F.col("p_start")) <= scope))
    weak_span = F.struct(*[F.col(f"w_{c}").alias(c) for c in ("start", "ord", "kind", "end")])
    link = F.struct("w_start", "w_ord", "w_kind", "p_start", "p_ord", "p_kind")
    linked = pairs.groupBy("rid").agg(F.collect_set(weak_span).alias("linked"), F.collect_list(link).alias("links"))
    none, no_links = F.array().cast(f"array<{SPAN}>"), F.array().cast("array<struct<w_start:int,w_ord:int,w_kind:string,p_start:int,p_ord:int,p_kind:string>>")
    own = parts.where("strong").groupBy("rid").agg(F.collect_list(F.struct("start", "ord", "kind", "end")).alias("base"))
    rest = rest.join(own, "rid", "left").join(linked, "rid", "left")
    empty = {"base": none, "linked": none, "links": no_links}
    both = plain.withColumns(empty).unionByName(rest.withColumns({k: F.coalesce(k, v) for k, v in empty.items()}))
    named = F.transform(F.array_sort("links"), lambda x: F.concat(x["w_kind"], F.lit(":"), x["w_start"].cast("string"), F.lit(">"), x["p_kind"], F.lit(":"), x["p_start"].cast("string")))
    return both.select(
        F.col("id").alias(id_col),
        *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
        F.array_join(named, ",").alias("links"),
    )
