"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE_CHARS = 200

#: Base kinds: (kind, pattern, group whose length counts, least length).
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 8), ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]{32,}", 32))
#: Weak candidates: of no weight alone.
WEAK = (
    ("login", r"""(?:[Uu]ser(?:[Nn]ame|_[Nn]ame|_?[Ii][Dd])?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccount_?[Ii][Dd]|[Tt]enant_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""),
    ("blob", r"""[A-Za-z0-9+/]{40,}={0,2}"""),
    ("endpoint", r"""(?:https?|ftps?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x00-\x20"'<>]{4,}"""),
)
#: What a match must also hold.
NEEDS = {"blob": (r"[0-9]", r"[A-Z]", r"[a-z]")}
KINDS = [k for k, *_ in BASE] + [k for k, _ in WEAK]
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "login"), ("assign", "hex", "blob"), ("endpoint",)
_SPAN = "array<struct<start:bigint,stop:bigint,kind:int>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


_WIDER, _ROUNDS = 8, 9  # arrays end before 8**10 entries


def _running(items: Column, join, k: int = 0) -> Column:
    """Running combination of an array from its start, each entry included, in rounds that widen the reach of every
    entry eightfold: n log n steps. ``join`` takes an entry and an earlier one, which is null before the start."""
    step = _WIDER**k
    back = F.sequence(F.lit(step), F.lit((_WIDER - 1) * step), F.lit(step))
    wider = F.transform(items, lambda x, i: F.aggregate(back, x, lambda acc, j: join(acc, F.get(items, i - j))))
    if k == _ROUNDS:
        return wider
    return F.when(F.size(items) <= step, items).otherwise(_let(wider, lambda y: _running(y, join, k + 1)))


def _lengths(text: Column, pattern: str, least: int = 0, group: int = 0, needs: tuple[str, ...] = ()) -> Column:
    """The leftmost non-overlapping matches in order: ``both`` (code points of a match and of the text between it and the
    one before), ``m`` (of the match) and ``ok`` (whether it counts)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    holds = lambda x: functools.reduce(operator.and_, [x["m"].rlike(n) for n in needs], F.length(x["p"]) >= least)
    size = lambda x: F.coalesce(F.length(x), F.lit(0)).cast("long")
    lengths = F.transform(F.arrays_zip(between.alias("b"), found.alias("m"), parts.alias("p")), lambda x: F.struct((size(x["b"]) + size(x["m"])).alias("both"), size(x["m"]).alias("m"), F.coalesce(holds(x), F.lit(False)).alias("ok")))
    return F.when(text.rlike(pattern), lengths).otherwise(F.array().cast("array<struct<both:bigint,m:bigint,ok:boolean>>"))


def _spans(text: Column) -> Column:
    """All matches that count, of all kinds, as (start, stop, kind) in code points, sorted. A match ends where all matches
    and the text between them up to it end."""
    lengths = [_lengths(text, p, least, 1 if k == "assign" else 0) for k, p, least in BASE] + [_lengths(text, p, needs=NEEDS.get(k, ())) for k, p in WEAK]

    def placed(x: Column, kind: Column) -> Column:
        ends = _let(F.transform(x, lambda y: y["both"]), lambda y: _running(y, lambda acc, b: acc + F.coalesce(b, F.lit(0))))
        spans = _let(ends, lambda e: F.transform(x, lambda y, i: F.struct((F.get(e, i) - y["m"]).alias("start"), F.get(e, i).alias("stop"), kind.alias("kind"), y["ok"].alias("ok"))))
        return F.transform(F.filter(spans, lambda y: y["ok"]), _plain)

    return F.sort_array(F.flatten(F.transform(F.array(*lengths), placed)))


def _plain(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))


_ROLES = {"i": IDENTIFIERS, "s": SECRETS, "e": ENDPOINTS}


def _of(s: Column, kinds: tuple[str, ...]) -> Column:
    return s["kind"].isin([KINDS.index(k) for k in kinds])


def _reach(spans: Column, scope: int, side: Column) -> Column:
    """For each span, by role, how far the parts in its scope reach. ``side`` 1: the greatest stop of the parts that start
    at most ``scope`` after it; ``side`` -1, negated: the least start of those that stop at most ``scope`` before it.

    An interval join by sorting: parts and questions stand in one sorted array, the answers are running maxima.
    """
    low = lambda s: F.when(side > 0, s["start"]).otherwise(-s["stop"])
    high = lambda s: F.when(side > 0, s["stop"]).otherwise(-s["start"])
    event = lambda at, ask, n, values: F.struct(at.alias("at"), F.lit(ask).alias("ask"), n.alias("n"), *[v.alias(r) for r, v in values.items()])
    parts = F.transform(spans, lambda s, n: event(low(s), 0, n, {r: F.when(_of(s, kinds), high(s)) for r, kinds in _ROLES.items()}))
    asked = F.transform(spans, lambda s, n: event(high(s) + scope, 1, n, dict.fromkeys(_ROLES, F.lit(None).cast("long"))))
    further = lambda a, b: F.struct(*[F.greatest(a[r], b[r]).alias(r) for r in _ROLES])
    values = lambda x: F.transform(x, lambda e: F.struct(*[e[r].alias(r) for r in _ROLES]))
    answer = lambda x, far: F.filter(F.transform(x, lambda e, i: F.struct(F.when(e["ask"] == 1, e["n"]).alias("n"), *[F.get(far, i)[r].alias(r) for r in _ROLES])), lambda e: e["n"].isNotNull())
    swept = _let(F.sort_array(F.concat(parts, asked)), lambda x: _let(_let(values(x), lambda v: _running(v, further)), lambda far: answer(x, far)))
    return F.sort_array(swept)


FOUND = ("base", "weak", "linked")


def scan(documents: DataFrame, scope: int = SCOPE_CHARS) -> DataFrame:
    """Add ``base``, ``weak`` and ``linked`` to every document: arrays of (start, stop, kind) by start, then kind.

    ``base`` are the strong kinds, always reported. Multipart linking is an interval join, within each text, of
    access identifiers, secrets and endpoints at most ``scope`` code points apart. ``weak`` holds a weak candidate
    only if a complementary part is in its scope: a login or endpoint needs a secret, a blob an identifier.
    ``linked`` holds, for each identifier with a secret in scope, the span that covers it and all secrets and
    endpoints in its scope.

    The join sorts parts and questions and runs along them, n log n however many parts a text has; it
    happens within the row: no shuffle, no hot key, and a lost executor costs its own tasks only. A null text is
    empty; a text without parts has empty arrays; repeated rows are scanned once each; all input columns stay (new
    ones replace columns of the same name).
    """
    found = _scan(documents, scope)
    return found.select(*[F.col(f"_row.`{c}`") for c in documents.columns if c not in FOUND], *FOUND)


def _scan(documents: DataFrame, scope: int) -> DataFrame:
    """``_row`` (all input columns), and what ``scan`` adds."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    found = documents.select(row.alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    none = F.array().cast(_SPAN)
    found = found.withColumn("_all", _spans(F.col("_text"))).withColumn("base", F.filter("_all", lambda s: s["kind"] < len(BASE)))
    both = lambda x: F.transform(F.array(F.lit(1), F.lit(-1)), lambda side: _reach(x, scope, side))
    with_reach = lambda x: _let(both(x), lambda r: F.transform(x, lambda s, n: F.struct(s.alias("s"), F.get(r[0], n).alias("a"), F.get(r[1], n).alias("b"))))
    found = found.withColumn("_all", F.when(F.size("_all") > 1, _let(F.col("_all"), with_reach)))

    def near(x: Column, r: str) -> Column:
        return F.coalesce(x["a"][r] >= x["s"]["start"] - scope, F.lit(False))

    def hull(x: Column) -> Column:
        start = F.least(x["s"]["start"], *[F.when(near(x, r), -x["b"][r]) for r in "se"])
        stop = F.greatest(x["s"]["stop"], *[F.when(near(x, r), x["a"][r]) for r in "se"])
        return F.struct(start.alias("start"), stop.alias("stop"), F.lit(len(KINDS)).alias("kind"))

    weak = F.filter("_all", lambda x: (_of(x["s"], ("login", "endpoint")) & near(x, "s")) | (_of(x["s"], ("blob",)) & near(x, "i")))
    linked = F.filter("_all", lambda x: _of(x["s"], IDENTIFIERS) & near(x, "s"))
    once = lambda x: F.filter(x, lambda s, i: ~s.eqNullSafe(F.get(x, i - 1)))
    hulls = _let(F.sort_array(F.transform(linked, hull)), once)
    found = found.withColumn("weak", F.coalesce(F.transform(weak, lambda x: x["s"]), none)).withColumn("linked", F.coalesce(hulls, none))
    return found.select("_row", *FOUND)


def _label(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "linked"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _by_start(spans: Column) -> Column:
    """By start, then kind as listed."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.transform(order, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, (k, *_) in enumerate(BASE)],
        F.sha2(_label(_by_start(F.col("base"))), 256).alias("base_sha256"),
        _label(_by_start(F.concat("base", "weak", "linked"))).alias("spans"),
    )


#: Code points of the chunks that a text is cut into before ranges of it are taken.
_CHUNK = 256


def redact(documents: DataFrame, scope: int = SCOPE_CHARS, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every reported base and weak span replaced by ``mark`` (overlapping spans by one), other
    columns and rows unchanged; a null text stays null. What stays is taken from chunks of the text, so that a
    text of many spans is read once."""
    found = _scan(documents, scope).withColumn("_spans", F.sort_array(F.concat("base", "weak")))
    text = F.col("_row.text").cast("string")

    def rest(spans: Column) -> Column:
        """The ranges between the spans: from where all earlier ones end to where one starts."""
        ends = _let(F.transform(spans, lambda s: s["stop"]), lambda x: _running(x, F.greatest))
        zero = F.lit(0).cast("long")
        between = lambda e: F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(e, i - 1), zero).alias("start"), s["start"].alias("stop")))
        last = lambda e: F.array(F.struct(F.get(e, F.size(e) - 1).alias("start"), F.length(text).cast("long").alias("stop")))
        return _let(ends, lambda e: F.concat(F.filter(between(e), lambda x: x["start"] <= x["stop"]), last(e)))

    def taken(chunks: Column, x: Column) -> Column:
        lo, hi = F.floor(x["start"] / _CHUNK), F.ceil(x["stop"] / _CHUNK)
        part = F.array_join(F.slice(chunks, (lo + 1).cast("int"), (hi - lo).cast("int")), "")
        return F.when(x["start"] >= x["stop"], F.lit("")).otherwise(F.substring(part, (x["start"] - lo * _CHUNK + 1).cast("int"), (x["stop"] - x["start"]).cast("int")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    done = _let(chunks, lambda c: F.array_join(F.transform(_let(F.col("_spans"), rest), lambda x: taken(c, x)), mark))
    new = F.when(F.size("_spans") > 0, done).otherwise(text)
    return found.select(*[new.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in documents.columns])
