"""Secrets in texts, and weak parts of credentials that are linked where they stand together.

Found by themselves (leftmost, not overlapping within a kind; failing ones are dropped):

- assign: a name like password or token, ``:`` or ``=``, and a value of six characters or more;
- access: ``AKIA`` and capitals or digits, 20 characters or more;
- hex: 24 hexadecimal digits or more.

Weak parts mean nothing alone: identifiers (an assigned user, account or key id), secrets (a token of 20 characters
or more with a digit, a capital and a small letter anywhere in it, also right behind ``=`` or a quote, or a value assigned to
a name like pwd) and endpoints (an address, or a value assigned to a name like host). A weak secret and an identifier are
reported when at most ``REACH`` characters lie between them in one scope, whichever comes first and however long they are;
access keys count as identifiers. Assign and hex spans are secrets by themselves, so an identifier as near to one is reported
too. An endpoint is reported when it stands as near to a secret that is reported, weak or not. Parts that overlap are not linked
to each other. Scopes are the blocks of a text between blank lines. The parts meet in an interval join: by scope and by the bin
of ``REACH`` characters in which one ends and the other begins, so a bin holds a bounded number of parts.

Positions are code points, ends exclusive; equal starts go by the order of the kinds. Null texts count as empty. Texts are
scanned whole; the lengths of matches and of what lies between them are added up by a window per text, so the work grows
with the matches. Repeated rows are told apart by a number that is written with them. Empty tables give no rows; columns other
than doc_id and text are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhome.llm.common import text_or_empty
from nearhome.session import written

# fixed values
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of [0-9a-f]+ is as long as it gets, so this drops the shorter ones alone
LEAST = {"assign": 6, "access": 20, "hex": 24}
STRONG = ["assign", "access", "hex"]
KINDS = [*STRONG, "identifier", "secret", "endpoint"]

IDENTIFIER = r"""(?i:access_?key_?id|client_?id|account_?id|key_?id|user_?name|user_?id|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
SECRET = (
    r"""(?i:pwd|passphrase|private_?key|access_?key|credential|auth)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{6,}"""
    # the lookaheads go through the whole token, possessively, so each token is read four times at most
    r"""|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"""
)
ENDPOINT = (
    r"""(?i:https?|ftp|jdbc:[a-z]+|mysql|postgres(?:ql)?|mongodb|redis|amqps?|s3|ssh)://[^\x20\x09-\x0D"'<>]+"""
    r"""|(?i:hostname|host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{3,}"""
)
BREAK = r"\n[\x20\x09\r]*\n"
REACH = 300

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_PIECES = "array<struct<kind:int,place:int,gap:int,length:int,size:int>>"
_NUMBER = {k: i for i, k in enumerate(KINDS)}
_BREAK_KIND = -1


def pieces(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """(kind, place, gap, length, size) of all matches: how many characters lie before it, how long it and its ``group`` are."""
    regex = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("value"),
    )
    measured = F.transform(zipped, lambda piece, place: F.struct(
        F.lit(kind).alias("kind"), place.alias("place"), F.char_length(piece["gap"]).alias("gap"),
        F.char_length(piece["match"]).alias("length"), F.char_length(piece["value"]).alias("size"),
    ))
    return F.when(F.regexp_like(text, regex), measured).otherwise(F.array().cast(_PIECES)).cast(_PIECES)


def found_pieces(docs: DataFrame) -> DataFrame:
    """(row, doc_id, pieces): the matches of every kind, written; those of weak parts and blank lines only where they could be linked."""
    text = F.col("text")
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text")).select(
        "row", "doc_id", "text", pieces(text, ASSIGN, _NUMBER["assign"], 2).alias("assign"),
        pieces(text, ACCESS, _NUMBER["access"]).alias("access"), pieces(text, HEX, _NUMBER["hex"]).alias("hex"),
    )
    has = lambda pattern: F.regexp_like(text, F.lit(pattern))
    some = lambda kind: F.exists(kind, lambda piece: piece["size"] >= LEAST[kind])
    linkable = ((some("assign") | some("hex")) & (has(IDENTIFIER) | has(ENDPOINT))) | (has(SECRET) & (some("access") | has(IDENTIFIER)))
    weak = [pieces(text, p, k) for k, p in ((_NUMBER["identifier"], IDENTIFIER), (_NUMBER["secret"], SECRET), (_NUMBER["endpoint"], ENDPOINT), (_BREAK_KIND, BREAK))]
    none = F.array().cast(_PIECES)
    return written(base.withColumn("linkable", linkable).select(
        "row", "doc_id", F.concat("assign", "access", "hex", F.when(F.col("linkable"), F.concat(*weak)).otherwise(none)).alias("pieces"),
    ), "secret-pieces")


def placed_spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, end): where the matches lie, short ones of the strong kinds dropped, written."""
    rows = found.filter(F.size("pieces") > 0).select("row", F.inline("pieces"))
    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.coalesce("length", F.lit(0))).over(before), F.lit(0)) + F.col("gap")
    least = F.lit(0)
    for kind, size in LEAST.items():
        least = F.when(F.col("kind") == _NUMBER[kind], size).otherwise(least)
    placed = rows.withColumn("start", start.cast("int")).filter(F.col("length").isNotNull() & (F.col("size") >= least))
    return written(placed.select("row", "kind", "start", (F.col("start") + F.col("length")).alias("end")), "secret-places")


def linked_parts(spans: DataFrame) -> DataFrame:
    """(row, start, kind, end): weak parts that stand with their complement, weak or strong, of (row, kind, start, end)."""
    weak = spans.filter(F.col("kind") >= len(STRONG)).select("row").distinct()  # where there is anything to link
    # the scope is the number of blank lines before
    scope = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = spans.join(written(weak, "secret-rows"), "row", "left_semi").withColumn("scope", F.count_if(F.col("kind") == _BREAK_KIND).over(scope))
    parts = written(parts.filter("kind >= 0"), "secret-scopes")
    of = lambda *kinds: parts.filter(F.col("kind").isin([_NUMBER[k] for k in kinds]))
    near = written(_near(of("secret", "assign", "hex"), of("identifier", "access")), "secret-links")
    secrets = near.filter(F.col("kind") == _NUMBER["secret"]).select("row", "scope", *_own()).distinct()
    secrets = written(secrets.unionByName(of("assign", "hex").select("row", "scope", *_own())), "secret-reported")
    endpoints = _near(secrets, of("endpoint")).select("row", *_other())
    linked = secrets.select("row", *_own()).unionByName(near.select("row", *_other())).unionByName(endpoints)
    return linked.filter(F.col("kind") >= len(STRONG)).distinct()


def _own() -> list[str]:
    return ["start", "kind", "end"]


def _other() -> list[Column]:
    return [F.col(f"other_{c}").alias(c) for c in _own()]


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """The interval join: parts of both sides in one scope with ``REACH`` characters or less between them.

    One ends where the other begins, or at most a bin before.
    """
    ours = left.select("row", "scope", *_own())
    theirs = right.select("row", "scope", *[F.col(c).alias(f"other_{c}") for c in _own()])

    def followed(first: DataFrame, end: str, second: DataFrame, start: str) -> DataFrame:
        bin_of = lambda c: F.floor(F.col(c) / REACH)
        ends = first.withColumn("bin", F.explode(F.array(bin_of(end), bin_of(end) + 1)))
        pairs = ends.join(second.withColumn("bin", bin_of(start)), ["row", "scope", "bin"])
        return pairs.filter((F.col(start) - F.col(end)).between(0, REACH)).select(*columns)

    columns = ["row", "scope", *_own(), *[f"other_{c}" for c in _own()]]
    return followed(ours, "end", theirs, "other_start").unionByName(followed(theirs, "other_end", ours, "start"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, assign, access, hex, linked): arrays of (start, kind, end) per document."""
    found = found_pieces(docs)
    spans = placed_spans(found)
    linked = written(linked_parts(spans), "secret-linked")
    shown = spans.filter(F.col("kind").between(0, len(STRONG) - 1)).select("row", *_own()).unionByName(linked.select("row", *_own()))
    lists = written(shown.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*_own()))).alias("spans")), "secret-lists")
    joined = found.select("row", "doc_id").join(lists, "row", "left")
    every = F.coalesce("spans", F.array().cast(_SPANS))
    of = lambda low, high: F.filter(every, lambda s: s["kind"].between(low, high))
    return joined.select("row", "doc_id", *[of(_NUMBER[k], _NUMBER[k]).alias(k) for k in STRONG], of(len(STRONG), len(KINDS)).alias("linked"))


def span_list(*arrays: str) -> Column:
    """kind:start:end of all spans by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.concat(*arrays))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
