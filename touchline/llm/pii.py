"""Personal data and the terms that give it away, by column expressions only.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers. Redacting them
is not enough where the words beside them identify them as well. The information that a term t gives
about an entity e is their pointwise mutual information over the corpus,

    PMI(t; e) = log2( c(t, e) * N / (d(t) * m(e)) ),

with N documents, d(t) of them holding t, m(e) holding e, and c(t, e) holding t within the context of e.
It can reach IC(e) = log2(N / m(e)), where t occurs with e only. A term is disclosing if it gives at
least the share 1 - 1/2^strictness of IC(e), which is (c / d)^(2^strictness) * N >= m. Evidence must
come from two different texts at least, so that copies of one text prove nothing.

A disclosing term is generalised to its first letters if all words that begin so, taken as one
term, stay below the threshold, and removed otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ascii_lower, free_name, joinable
from touchline.session import materialise

#: Base kinds in order; the kinds of disclosing terms follow them.
BASE_KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalised", "removed")
KINDS = BASE_KINDS + TERM_KINDS

#: Patterns of the base kinds. A match can only begin where a run of its first class begins or the last
#: match ended; saying so, and possessive quantifiers, keep the search linear on any text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SMALL_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_VALUE = rf"^{SMALL_PART}\.{SMALL_PART}\.{SMALL_PART}\.{SMALL_PART}$"

#: A term is a run of letters: of ASCII only A-Z and a-z, and every other character.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters before and after an entity that are its context.
CONTEXT = 120
#: Letters that a generalised term keeps.
KEPT_LETTERS = 3
STRICTNESS = 2
_BLOCK = 64
SPAN = "array<struct<kind: string, start: int, end: int>>"


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often the result refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def running_sums(values: Column) -> Column:
    """Sums of all prefixes of a non-empty array of integers, by blocks, so long arrays stay cheap."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))

    def block(x: Column, b: Column) -> Column:
        return F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))

    def of_block(base: Column, own: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(own)), lambda k: base + _total(F.slice(own, F.lit(1), k)))

    def summed(x: Column) -> Column:
        return _named(
            F.transform(blocks, lambda b: _total(block(x, b))),
            lambda sums: F.flatten(
                F.transform(
                    blocks,
                    lambda b: _named(block(x, b), lambda own: of_block(_total(F.slice(sums, F.lit(1), b)), own)),
                )
            ),
        )

    return _named(values, summed)


def starts(hits: Column, gaps: Column) -> Column:
    """Start of each hit, in code points, from the hits and the text pieces around them."""
    lengths = F.zip_with(
        F.transform(F.slice(gaps, F.lit(1), F.size(hits)), lambda g: F.length(g)),
        F.concat(F.array(F.lit(0)), F.transform(F.slice(hits, F.lit(1), F.size(hits) - 1), lambda h: F.length(h))),
        lambda gap, hit: gap + hit,
    )
    return running_sums(lengths)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""

    def share(at: Column) -> Column:
        digit = F.substring(F.reverse(digits), at, F.lit(1)).cast("int")
        doubled = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return F.when(at % 2 == 0, doubled).otherwise(digit)

    return _total(F.transform(F.sequence(F.lit(1), F.length(digits)), share)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_VALUE)
    if kind == "card":
        return _named(
            _digits(value), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
        )
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """The name of an entity, without spaces and equal for different spellings."""
    return F.concat(F.lit(f"{kind}:"), {"email": ascii_lower, "ip": lambda v: v}.get(kind, _digits)(value))


def _context(body: Column, begin: Column, stop: Column, before: bool) -> Column:
    """Of a stretch of a text the end (or beginning) of CONTEXT characters, without a word that is cut."""
    long = stop - begin > CONTEXT
    first = F.when(long, stop - CONTEXT).otherwise(begin) if before else begin
    piece = F.substring(body, (first + 1).cast("int"), F.least(stop - begin, F.lit(CONTEXT)).cast("int"))
    whole = F.regexp_replace(piece, r"^[^\x20\x09-\x0D]+" if before else r"[^\x20\x09-\x0D]+$", "")
    return F.when(long, whole).otherwise(piece)


def _found(kind: str, body: Column, hits: Column) -> Column:
    """Valid matches of a kind as structs of kind, start, end, entity and context.

    A context ends at the next valid match of the kind; dropped matches are text as any other.
    """

    def around(valid: Column) -> Column:
        return F.transform(
            valid,
            lambda z, i: F.struct(
                F.lit(kind).alias("kind"), z["start"].alias("start"), z["end"].alias("end"),
                _entity(kind, z["value"]).alias("entity"),
                F.concat(
                    _context(body, F.when(i > 0, F.get(valid, i - 1)["end"]).otherwise(0), z["start"], True), F.lit(" "),
                    _context(body, z["end"], F.coalesce(F.get(valid, i + 1)["start"], F.length(body)), False),
                ).alias("context"),
            ),
        )

    zipped = F.arrays_zip(hits.alias("value"), starts(hits, F.split(body, PATTERNS[kind], -1)).alias("start"))
    valid = F.transform(
        F.filter(zipped, lambda z: _valid(kind, z["value"])),
        lambda z: F.struct(
            z["value"].alias("value"), z["start"].cast("int").alias("start"),
            (z["start"] + F.length(z["value"])).cast("int").alias("end"),
        ),
    )
    return F.when(F.size(hits) > 0, _named(valid, around))


def _items(text: Column) -> Column:
    """Distinct terms of a text, and the classes of words that they generalise to, marked by a star."""
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0)))
    return _named(
        terms,
        lambda t: F.concat(t, F.array_distinct(F.transform(t, lambda w: F.concat(F.left(w, F.lit(KEPT_LETTERS)), F.lit("*"))))),
    )


def _general(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(KEPT_LETTERS)), F.lit("*"))


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def base_spans(docs: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """Add the valid matches of the base kinds, by kind, then start, with entity and context.

    Offsets count code points, ends are exclusive. Per kind, matches are leftmost and do not overlap, and
    one that fails its check is dropped without another try. A null text is an empty one.
    """
    body = free_name(docs, "pii_body")
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    names = [free_name(docs, f"pii_{kind}") for kind in BASE_KINDS]
    df = df.select("*", *(
        F.when(F.contains(F.col(body), F.lit(mark)) if mark else F.col(body).rlike("[0-9]"),
               F.regexp_extract_all(F.col(body), F.lit(PATTERNS[kind]), F.lit(0))).alias(name)
        for kind, name, mark in zip(BASE_KINDS, names, ("@", ".", "", "+"))
    ))
    found = [_found(kind, F.col(body), F.col(name)) for kind, name in zip(BASE_KINDS, names)]
    return df.withColumn(out, F.flatten(F.array_compact(F.array(*found)))).drop(body, *names)


def disclosing(pairs: DataFrame, frequencies: DataFrame, rows: int, strictness: int = STRICTNESS) -> DataFrame:
    """(entity, term, kind) of all disclosing terms.

    ``pairs`` has a row (entity, item, blob) for each document, entity in it and item in the
    entity's context, and one with an empty item for the entity itself; ``frequencies`` has
    (item, held) for all items that matter; ``rows`` is the number of documents.
    """
    counted = materialise(
        pairs.groupBy("entity", "item").agg(
            F.count(F.lit(1)).alias("together"), (F.min("blob") < F.max("blob")).alias("supported")
        )
    )
    entities = counted.filter("item = ''").select("entity", F.col("together").alias("holding"))
    wanted = counted.filter("item <> '' and supported").drop("supported")
    share = F.col("together") / F.col("held")
    for _ in range(strictness):
        share = share * share
    judged = wanted.join(entities, "entity").join(frequencies, "item").filter(
        (share * rows >= F.col("holding")) & (F.col("holding") < rows)
    )
    judged = materialise(judged.select("entity", "item"))
    terms = judged.filter(~F.endswith("item", F.lit("*"))).withColumn("class", _general(F.col("item")))
    classes = judged.filter(F.endswith("item", F.lit("*"))).select("entity", F.col("item").alias("class"), F.lit(True).alias("kept"))
    return terms.join(classes, ["entity", "class"], "left").select(
        "entity", F.col("item").alias("term"),
        F.when(F.col("kept"), F.lit("removed")).otherwise(F.lit("generalised")).alias("kind"),
    )


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _term_spans(body: Column, flags: Column, base: Column) -> Column:
    """Spans of all words of a text that ``flags`` (map of term to kind) names, outside of base spans."""

    def of_words(words: Column) -> Column:
        zipped = F.arrays_zip(words.alias("word"), starts(words, F.split(body, TERM, -1)).alias("start"))
        named = F.transform(
            zipped,
            lambda z: F.struct(
                F.try_element_at(flags, ascii_lower(z["word"])).alias("kind"), z["start"].cast("int").alias("start"),
                (z["start"] + F.length(z["word"])).cast("int").alias("end"),
            ),
        )
        return F.filter(
            F.filter(named, lambda s: s["kind"].isNotNull()),
            lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        )

    words = F.regexp_extract_all(body, F.lit(TERM), F.lit(0))
    ordered = _named(
        _named(words, of_words),
        lambda spans: F.concat(*(_of_kind(spans, kind) for kind in TERM_KINDS)),
    )
    return F.when(flags.isNotNull() & (F.size(flags) > 0), ordered)


def scan(docs: DataFrame, text: str = "text", strictness: int = STRICTNESS, keep_text: bool = True) -> DataFrame:
    """Add ``spans`` (kind, start, end) to every row: the base kinds in order, then disclosing terms.

    The corpus is the table itself: every row counts as a document, while evidence of one text only
    discloses nothing. In a text with protected entities, a term of an entity's context that
    discloses it is marked wherever the text has it as a whole word. Texts without entities get no spans.

    A null text is empty and has no spans. Spans of one kind never overlap; a term that lies in a
    base span is not marked. All rows, repeated ones too, keep their own result; equal texts have equal
    spans; an empty table gives an empty one. A column named ``spans`` is replaced; without
    ``keep_text`` the text is left out.
    """
    df = docs.drop(*(name for name in ("spans",) if name != text))
    kept = [name for name in df.columns if keep_text or name != text]
    found, blob, body, spans, flags, contexts = (
        free_name(df, f"pii_{name}") for name in ("found", "blob", "body", "spans", "flags", "contexts")
    )
    some = F.size(found) > 0
    measured = materialise(
        base_spans(df, text, found).select(
            *(F.col(f"`{name}`") for name in kept),
            F.transform(found, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias(spans),
            F.transform(found, lambda f: F.struct(f["entity"].alias("entity"), f["context"].alias("context"))).alias(contexts),
            F.when(some, F.sha2(text, 256)).alias(blob),
            F.when(some, F.col(text)).alias(body),
        )
    )
    holding = measured.filter(F.col(blob).isNotNull())
    # Strings, as arrays of structs are not made distinct by hashing; entities and terms have no spaces.
    named = F.flatten(
        F.transform(
            contexts,
            lambda c: F.transform(
                F.concat(F.array(F.lit("")), _items(c["context"])), lambda item: F.concat(c["entity"], F.lit(" "), item)
            ),
        )
    )
    pairs = holding.select(F.explode(F.array_distinct(named)).alias("pair"), F.col(blob).alias("blob")).select(
        F.substring_index("pair", " ", 1).alias("entity"), F.substring_index("pair", " ", -1).alias("item"), "blob"
    )
    frequencies = (
        docs.select(F.explode(_items(F.coalesce(F.col(text), F.lit("")))).alias("item"))
        .groupBy("item").agg(F.count(F.lit(1)).alias("held"))
    )
    flagged = joinable(disclosing(pairs, frequencies, measured.count(), strictness))
    by_text = (
        pairs.join(flagged.withColumnRenamed("term", "item"), ["entity", "item"])
        .groupBy(F.col("blob").alias(f"{blob}_"), "item").agg(F.max("kind").alias("kind"))
        .groupBy(f"{blob}_").agg(F.map_from_entries(F.collect_list(F.struct("item", "kind"))).alias(flags))
    )
    own = [F.col(f"`{name}`") for name in kept]
    marked = F.coalesce(_term_spans(F.col(body), F.col(flags), F.col(spans)), F.array().cast(SPAN))
    with_terms = holding.join(by_text, F.col(blob) == F.col(f"{blob}_"), "left").select(
        *own, F.concat(spans, marked).alias("spans")
    )
    return measured.filter(F.col(blob).isNull()).select(*own, F.col(spans).alias("spans")).unionByName(with_terms)


def sanitise(scanned: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace base spans by ``[kind]``, generalise or remove disclosing terms.

    Overlapping spans are replaced once, by the one that starts first (of equal starts, the longer).
    Rows without spans stay as they are, null texts included.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def instead(s: Column) -> Column:
        word = F.substring(whole, s["start"] + 1, F.lit(KEPT_LETTERS))
        return F.when(s["kind"] == "generalised", F.concat(word, F.lit("*"))).when(
            s["kind"] == "removed", F.lit("")
        ).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(whole, state["at"] + 1, s["start"] - state["at"])
        return F.when(
            s["start"] >= state["at"],
            F.struct(F.concat(state["done"], before, instead(s)).alias("done"), (-s["back"]).alias("at")),
        ).otherwise(state)

    folded = F.aggregate(
        ordered, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), step,
        lambda state: F.concat(state["done"], F.substring(whole, state["at"] + 1, F.length(whole))),
    )
    return scanned.withColumn(text, F.when(F.size(spans) > 0, folded).otherwise(F.col(text)))
