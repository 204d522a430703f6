"""Byte-level BPE over Arrow batches: ids, character offsets, and decoding.

The ``tokenizers`` library does the merges. A byte-level vocabulary names each of the 256
bytes by a printable character; the table between the two is built here and used in both
directions. Texts are cut at spaces that no match of the pre-tokenizer's pattern can span,
and the pieces' ids are remembered per worker, so each distinct piece is encoded once.
"""

from __future__ import annotations

import base64
import codecs
import json
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import bound_batches, releasing, slices, with_arrow_columns

BATCH_BYTES = 4 << 20
MAX_CACHED_PIECES = 100_000
MAX_CACHED_LENGTH = 64
ENCODE_AT_ONCE = 64 << 10
#: Between two characters that are not white space, before a single space.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_LINE_PAIRS = tuple(pair for c in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r") for pair in (b"\n" + c, c + b"\n"))
_SPACE_PAIRS = tuple(pair for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") for pair in (b" " + c, c + b" "))


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(byte if byte in printable else next(spare)) for byte in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merges of lower rank leave of a token; None if they leave more."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= ranks[token]:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def tokenizer_json(ranks_path: str, pattern: str) -> str:
    """A rank file as the serialised tokenizer that splits by ``pattern`` and merges by rank."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(ranks_path)
    named = byte_characters()
    name = {token: "".join(named[byte] for byte in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and (parts := _last_merge(token, ranks)):
            merges.append((name[parts[0]], name[parts[1]]))
    built = Tokenizer(models.BPE({name[token]: rank for token, rank in ranks.items()}, merges))
    built.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return built.to_str()


@lru_cache(maxsize=4)
def load_tokenizer(serialised: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(serialised)


class PieceCache:
    """Remembers the encoded bytes of pieces in two generations of bounded size."""

    def __init__(self, encode: Callable[[list], list[bytes]], most: int = MAX_CACHED_PIECES):
        self._encode = encode
        self._most = most
        self._young: dict = {}
        self._old: dict = {}

    def __call__(self, pieces: list) -> list[bytes]:
        found = list(map(self._young.get, pieces))
        if None not in found:
            return found
        places = [at for at, value in enumerate(found) if value is None]
        fresh = dict.fromkeys(pieces[at] for at in places)
        missing = []
        for piece in fresh:
            if (value := self._old.get(piece)) is None:
                missing.append(piece)
            else:
                fresh[piece] = value
        begin = size = 0
        for at, piece in enumerate(missing):
            size += len(piece) + 1
            if size > ENCODE_AT_ONCE or at + 1 == len(missing):
                fresh.update(zip(missing[begin : at + 1], self._encode(missing[begin : at + 1])))
                begin, size = at + 1, 0
        for at in places:
            found[at] = fresh[pieces[at]]
        self._young.update(item for item in fresh.items() if len(item[0]) <= MAX_CACHED_LENGTH)
        if len(self._young) > self._most:
            self._old, self._young = self._young, {}
        return found


_MARKS = ".,;:!?"
#: Characters whose classes, cases and compositions all Unicode versions agree on.
_PLAIN = re.compile("[\x20-\x7e\xa1-\u024f]*")


class PieceEncoder:
    """Ids of pieces as little-endian bytes; ``kind`` is the struct letter of an id.

    Whole pieces can go through the tokenizer. For plain characters, and where the tokenizer
    splits by one pattern and maps bytes, the pattern is applied here and the model merges each
    distinct part once; that saves the library's bookkeeping for every piece.
    """

    def __init__(self, engine, kind: str = "i"):
        import regex

        self._engine, self._kind = engine, kind
        form = json.loads(engine.to_str())
        self._special = re.compile("|".join(re.escape(token["content"]) for token in form["added_tokens"]) or "(?!)")
        normalizers = (form["normalizer"] or {}).get("normalizers", [form["normalizer"]] if form["normalizer"] else [])
        steps = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [step["type"] for step in normalizers]
        split = steps[0] if [step["type"] for step in steps] == ["Split", "ByteLevel"] else None
        plain = (
            split is not None
            and set(kinds) <= {"NFC", "Lowercase", "Replace"}
            and all(step["pattern"] == {"Regex": "\\s+"} and step["content"] == " " for step in normalizers if step["type"] == "Replace")
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and (split["behavior"], split["invert"]) in {("Isolated", False), ("Removed", True)}
            and "Regex" in split["pattern"]
        )
        self._pattern = regex.compile(split["pattern"]["Regex"]) if plain else None
        self._all_parts = plain and split["behavior"] == "Isolated"
        self._lower = "Lowercase" in kinds
        # Letters are one part, and a mark after them another one: most pieces need no pattern.
        self._letters_first = plain and all(
            self._pattern.findall(space + "é" * n + mark) == [space + "é" * n] + [mark] * bool(mark)
            for n in range(1, MAX_CACHED_LENGTH)
            for mark in ("", *_MARKS)
            for space in ("", " " * self._all_parts)
        )
        self._names = dict(enumerate(byte_characters()))
        self._parts = PieceCache(self._merge)

    def _merge(self, parts: list[str]) -> list[bytes]:
        tokenize, names, space, kind = self._engine.model.tokenize, self._names, self._names[32], self._kind
        out = []
        for part in parts:
            # Printable characters of ASCII stand for themselves.
            named = part.replace(" ", space) if part.isascii() else part.encode().decode("latin1").translate(names)
            tokens = tokenize(named)
            out.append(struct.pack(f"<{len(tokens)}{kind}", *[token.id for token in tokens]))
        return out

    def _split(self, piece: str) -> list[str] | None:
        if self._letters_first and len(piece) <= MAX_CACHED_LENGTH and (piece.isascii() or _PLAIN.fullmatch(piece)):
            whole = piece.lower() if self._lower else piece
            marked = whole[-1] in _MARKS
            if whole[1 if whole[0] == " " else 0 : -1 if marked else None].isalpha():
                return [whole[:-1], whole[-1]] if marked else [whole]
        if not _PLAIN.fullmatch(piece) or self._special.search(piece):
            return None
        if self._lower:
            piece = piece.lower()
        parts = self._pattern.findall(piece)
        return parts if not self._all_parts or "".join(parts) == piece else None

    def __call__(self, pieces: list[str]) -> list[bytes]:
        split = [None if self._pattern is None else self._split(piece) for piece in pieces]
        ids = self._parts([part for parts in split if parts for part in parts])
        rest = [piece for piece, parts in zip(pieces, split) if parts is None]
        whole = iter(self._engine.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        out, at = [], 0
        for parts in split:
            if parts is None:
                found = next(whole).ids
                out.append(struct.pack(f"<{len(found)}{self._kind}", *found))
            elif len(parts) == 1:
                out.append(ids[at])
                at += 1
            else:
                out.append(b"".join(ids[at : at + len(parts)]))
                at += len(parts)
        return out


def pieces_of(body: bytes) -> list[bytes]:
    """Parts of a text in UTF-8 that the pre-tokenizer treats independently of each other."""
    if not body:
        return []
    if (
        body.startswith(b" ") or body.endswith(b" ") or b"\0" in body
        or any(pair in body for pair in _SPACE_PAIRS)
        or (not body.isascii() and _WIDE_SPACE.search(body))
    ):
        return [piece.encode() for piece in _CUT.split(body.decode())]
    # A line break between two characters that are not white space is a part of its own.
    if b"\n" in body and body[0] != 10 and body[-1] != 10 and not any(pair in body for pair in _LINE_PAIRS):
        body = body.replace(b"\n", b"\0\n\0")
    return body.replace(b" ", b"\0 ").split(b"\0")


@lru_cache(maxsize=4)
def _caches(serialised: str) -> tuple[PieceCache, PieceCache]:
    engine = load_tokenizer(serialised)

    encode_pieces = PieceEncoder(engine)

    def ids(pieces: list[bytes]) -> list[bytes]:
        return encode_pieces([piece.decode() for piece in pieces])

    def spans(pieces: list[bytes]) -> list[bytes]:
        return [
            np.asarray(e.offsets, "<i4").reshape(-1, 2).tobytes()
            for e in engine.encode_batch([piece.decode() for piece in pieces], add_special_tokens=False)
        ]

    return PieceCache(ids), PieceCache(spans)


def forget() -> None:
    """Drop all remembered pieces of this worker."""
    _caches.cache_clear()


def _lists(values: np.ndarray, lengths: list[int]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _encode_texts(texts: Iterable[bytes], serialised: str, offsets: bool) -> dict[str, pa.Array]:
    ids_of, spans_of = _caches(serialised)
    ids, spans, lengths = [], [], []
    for text in texts:
        pieces = pieces_of(text)
        encoded = b"".join(ids_of(pieces))
        ids.append(encoded)
        lengths.append(len(encoded) // 4)
        if offsets:
            parts = spans_of(pieces)
            begins = np.concatenate([[0], np.cumsum([len(piece.decode()) for piece in pieces])])[: len(pieces)]
            local = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2)
            spans.append(local + np.repeat(begins, [len(part) // 8 for part in parts]).astype("<i4")[:, None])
    columns = {"ids": _lists(np.frombuffer(b"".join(ids), "<i4"), lengths)}
    if offsets:
        both = np.concatenate([np.empty((0, 2), "<i4"), *spans])
        columns |= {"starts": _lists(both[:, 0].copy(), lengths), "ends": _lists(both[:, 1].copy(), lengths)}
    return columns


def encode(
    docs: DataFrame, serialised: str, text: str = "text", offsets: bool = True, keep_text: bool = True
) -> DataFrame:
    """Add ``ids`` and, with ``offsets``, the character ``starts`` and ``ends`` of every token.

    A token that is a part of a character spans that whole character. Null and empty texts
    have no tokens. Every row is encoded on its own, in full, whatever its length; repeated
    rows and ties need no rule; an empty table gives an empty result. Columns named ids,
    starts or ends are replaced. ``serialised`` comes from ``tokenizer_json``; no special
    tokens are added or recognised.
    """
    bound_batches(docs.sparkSession)
    names = ("ids", "starts", "ends") if offsets else ("ids",)
    df = docs.drop(*(name for name in names if name != text)).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    dropped = (text,) if not keep_text else ()
    fields = [f for f in df.schema.fields if f.name not in dropped]
    schema = T.StructType(fields + [T.StructField(name, T.ArrayType(T.IntegerType())) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, BATCH_BYTES):
            yield with_arrow_columns(
                batch, dropped, _encode_texts(batch.column(text).cast(pa.binary()).to_pylist(), serialised, offsets)
            )

    return df.mapInArrow(releasing(run, forget), schema)


@lru_cache(maxsize=4)
def _token_table(serialised: str) -> pa.Array:
    """The bytes of every id, and at the end those of an unknown one."""
    byte_of = {character: byte for byte, character in enumerate(byte_characters())}
    vocabulary = json.loads(serialised)["model"]["vocab"]
    table = ["�".encode()] * (max(vocabulary.values(), default=-1) + 1)
    for token, number in vocabulary.items():
        table[number] = bytes(byte_of[character] for character in token)
    return pa.array([*table, "�".encode()], pa.binary())


def _tokens(ids: pa.Array, table: pa.Array) -> pa.Array:
    """Lists of the bytes of each id, without nulls; a null list is an empty one."""
    lengths = pc.fill_null(pc.list_value_length(ids), 0)
    offsets = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False), dtype=np.int64)]).astype(np.int32)
    numbers = ids.flatten()
    unknown = len(table) - 1
    known = pc.and_(pc.greater_equal(numbers, 0), pc.less(numbers, unknown))
    places = pc.fill_null(pc.if_else(known, numbers, unknown), unknown)
    return pa.ListArray.from_arrays(pa.array(offsets), table.take(places))


def token_texts(tokens: Iterable[bytes]) -> list[str]:
    """The text that each token completes; bytes of a split character count for its last token."""
    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    texts = [decoder.decode(token) for token in tokens]
    if rest := decoder.decode(b"", final=True):
        texts[-1] += rest
    return texts


def decode(df: DataFrame, serialised: str, ids: str = "ids", per_token: bool = False) -> DataFrame:
    """Add ``decoded`` (bytes), and with ``per_token`` the array ``token_texts``.

    Bytes are joined before they are read as text, so characters that tokens split are whole
    again. Null ids decode to nothing, unknown or null entries to U+FFFD. Columns of the
    added names are replaced.
    """
    names = ("decoded", "token_texts") if per_token else ("decoded",)
    df = df.drop(*(name for name in names if name != ids))
    added = [T.StructField("decoded", T.BinaryType())]
    if per_token:
        added.append(T.StructField("token_texts", T.ArrayType(T.StringType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_table(serialised)
        for batch in batches:
            tokens = _tokens(batch.column(ids), table)
            columns = {"decoded": pc.binary_join(tokens, pa.scalar(b"", pa.binary()))}
            if per_token:
                texts = [token_texts(row) if row else [] for row in tokens.to_pylist()]
                columns["token_texts"] = pa.array(texts, pa.list_(pa.string()))
            yield with_arrow_columns(batch, (), columns)

    return df.mapInArrow(run, T.StructType(df.schema.fields + added))
