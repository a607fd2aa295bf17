"""Token counts and ids with a piece memo, and the digest cache of counts.

The tokenizer files are used as they are, through their library. Both kinds of file split
a text into pieces that never cross certain boundaries (see :class:`Pieces`); a piece is
encoded once per worker and looked up afterwards, which gives the library's own result.

Digest cache (:func:`count_tokens`): a stored table maps (tokenizer version digest,
content digest) to a count. The normalised contents' digests join it; only distinct
missing contents are encoded, each once, and appended.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.llm import common

#: A memo that has grown beyond this many entries becomes the old generation.
MEMO = 400_000
#: White space outside ASCII and the ASCII separators, as UTF-8.
ODD_SPACES = tuple(
    chr(c).encode() for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_BESIDE_SPACE = tuple(x for c in (b"\t", b"\n", b"\v", b"\f", b"\r", b" ") for x in (b" " + c, c + b" "))
_EDGES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r", *ODD_SPACES)
_ASCII_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


#: The byte-level alphabet: a printable Latin-1 byte is its own character, the n-th other one is character 256 + n.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
_ALPHABET = "".join(chr(_OTHERS.get(b, b)) for b in range(256))


class Memo(dict):
    """Encodings by piece; what is missing is made by ``make``. Two bounded generations."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: bytes):
        value = self.old.get(piece)
        self[piece] = value = self.make(piece) if value is None else value
        return value

    def age(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.old = {}
        self.clear()


class Pieces:
    """Encodes texts piece by piece, which gives the library's result for the whole text.

    A tokenizer that turns runs of white space into one and drops them (``spaceless``)
    treats every word alone. A byte-level one attaches a single space to the word behind
    it; a text may be cut before such a space, provided that it stands between two
    characters that are not white space. Elsewhere neighbours stay together. A letter and
    a following run of ASCII punctuation never share a token in either.
    """

    def __init__(self, path: str, ids: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaceless = spaceless(path)
        self.ids = ids
        self.plain = Memo(self._plain)
        self.spaced = Memo(self._spaced)

    def _whole(self, piece: bytes):
        e = self.tokenizer.encode(piece.decode(), add_special_tokens=False)
        return struct.pack(f"<{len(e)}I", *e.ids) if self.ids else len(e)

    def _letters(self, word: bytes):
        """A space and letters are one unit: the model takes it in the byte alphabet, without the library's splitting."""
        made = self.tokenizer.model.tokenize(codecs.charmap_decode(b" " + word, "strict", _ALPHABET)[0])
        return struct.pack(f"<{len(made)}I", *[t.id for t in made]) if self.ids else len(made)

    def _ends(self, piece: bytes) -> tuple[bytes, bytes] | None:
        """A piece that ends in a letter and punctuation, cut between the two."""
        word = piece.rstrip(_ASCII_PUNCTUATION)
        if word and len(word) < len(piece) and word[-1:].isalpha() and b"<|" not in piece:
            return word, piece[len(word):]
        return None

    def _plain(self, piece: bytes):
        ends = self._ends(piece)
        return self.plain[ends[0]] + self.plain[ends[1]] if ends else self._whole(piece)

    def _spaced(self, word: bytes):
        """``word`` with the one space before it."""
        if word.isalpha():  # ASCII letters
            return self._letters(word)
        lines = word.split(b"\n")
        if len(lines) > 1 and all(x and x == x.strip() for x in lines):
            value = self.spaced[lines[0]]
            for x in lines[1:]:
                value += self.plain[b"\n"] + self.plain[x]
            return value
        ends = self._ends(word)
        if ends:
            return self.spaced[ends[0]] + self.plain[ends[1]]
        return self._letters(word) if word.decode().isalpha() else self._whole(b" " + word)

    def _one(self, text: str):
        data = common.utf8(text)
        join = b"".join if self.ids else sum
        if self.spaceless:
            # Lower case first is the same, but for letters that compose with a mark behind them.
            if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
                data = data.lower()
            return join(map(self.plain.__getitem__, data.split()))
        if not data:
            return join([])
        first, *rest = data.split(b" ")
        odd = ODD_SPACES[:4] if data.isascii() else ODD_SPACES
        if first and (not rest or rest[-1]) and not any(x in data for x in _BESIDE_SPACE) and not any(x in data for x in odd):
            return join([self.plain[first], *map(self.spaced.__getitem__, rest)])
        parts, now = [], first
        for x in rest:
            if now and x and not now.endswith(_EDGES) and not x.startswith(_EDGES):
                parts.append(now)
                now = b" " + x
            else:
                now += b" " + x
        return join([*map(self._whole, parts), self._whole(now)])

    def encode(self, texts: list[str]) -> list:
        """Counts, or the ids as little-endian 32-bit bytes, of each text."""
        self.plain.age()
        self.spaced.age()
        return [self._one(t) for t in texts]

    def forget(self) -> None:
        """Called at the end of a task: workers are used again, and other stages need the memory."""
        self.plain.forget()
        self.spaced.forget()


@lru_cache(maxsize=4)
def pieces(path: str, ids: bool) -> Pieces:
    """One encoder for each file and worker."""
    return Pieces(path, ids)


@lru_cache(maxsize=16)
def spaceless(path: str) -> bool:
    """True if the tokenizer's own rules make every run of white space one and then drop it."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    norm = json.dumps(rules.get("normalizer") or {})
    pre = rules.get("pre_tokenizer") or {}
    splits = [p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"]
    return '"\\\\s+"' in norm and any(p.get("behavior") == "Removed" and p.get("invert") for p in splits)


def version_digest(path: str) -> str:
    """Names the tokenizer: its file's content and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


@common.own_batches
def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: the id, ``n_bytes, n_tokens, over_limit``.

    ``path`` names a ``tokenizers`` file that exists on every machine. ``cache`` is a
    folder that all executors share; new counts are appended to it, and a later call, for
    any table, encodes only contents it has not seen. Without one, a fresh folder is used.
    Each call appends a folder of its own, so calls at the same time, or one that is
    repeated after a failure, disturb no other; a digest that is stored twice is one count.

    A null text counts as empty: 0 bytes, 0 tokens. Special strings inside a text are
    matched as the library does by default; none are added. Repeated rows and equal
    contents are encoded once. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    cache = cache or session.shared_dir(spark, "token-counts")
    version = version_digest(path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # White space that the tokenizer makes one and drops does not tell contents apart.
    content = F.regexp_replace(text, common.SPACE + "+", " ") if spaceless(path) else text
    digest = F.unhex(F.sha2(content, 256))
    keys = common.written(
        docs.select(F.col(f"`{id_col}`").alias("_id"), common.mark(F.col(f"`{text_col}`")).alias("_mark"), digest.alias("_digest"), F.octet_length(text).cast("bigint").alias("n_bytes")),
        "token-keys",
    )
    stored = "version string, _digest binary, n_tokens bigint"

    def counts() -> DataFrame:
        try:
            rows = spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(cache).where(F.col("version") == version)
        except AnalysisException:  # nothing stored yet
            return spark.createDataFrame([], "_digest binary, n_tokens bigint")
        return rows.groupBy("_digest").agg(F.max("n_tokens").alias("n_tokens"))

    chosen = keys.groupBy("_digest").agg(F.min(F.struct("_mark", "_id")).alias("_first"))
    missing = chosen.join(counts().select("_digest"), "_digest", "left_anti").select("_first._mark", "_first._id").hint("shuffle_hash")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), common.mark(F.col(f"`{text_col}`")).alias("_mark"), text.alias("_text"), digest.alias("_digest"))
    texts = rows.join(missing, common.same_mark(rows, missing), "left_semi").select("_digest", "_text")

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path, False)
        for batch in it:
            made = encoder.encode(common.texts_of(batch.column("_text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(made), pa.string()), batch.column("_digest"), pa.array(made, pa.int64())], ["version", "_digest", "n_tokens"]
            )
        encoder.forget()

    # A document stored twice is met twice; its content is stored once.
    made = texts.mapInArrow(encode, stored).groupBy("version", "_digest").agg(F.max("n_tokens").alias("n_tokens"))
    made.write.parquet(f"{cache}/{os.urandom(8).hex()}")
    return keys.join(counts(), "_digest").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def token_rows(docs: DataFrame, path: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``_id, doc_tokens``, the CRC-32 of each full part of ``length`` ids, and the rest's ids.

    Ids are the tokenizer's, then ``end_id``. ``_rest`` holds little-endian 32-bit ids.
    """
    import zlib

    import numpy as np

    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    end = np.array([end_id], "<u4").tobytes()
    names = ["_id", "doc_tokens", "_full", "_rest_crc", "_rest"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path, True)
        for batch in it:
            made = []
            for ids in encoder.encode(common.texts_of(batch.column("_text"))):
                ids += end
                whole = len(ids) // (4 * length) * 4 * length
                full = [zlib.crc32(ids[i : i + 4 * length]) for i in range(0, whole, 4 * length)]
                made.append((len(ids) // 4, full, zlib.crc32(ids[whole:]), ids[whole:]))
            columns = zip(*made, strict=True) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)
        encoder.forget()

    schema = T.StructType([rows.schema["_id"], *T._parse_datatype_string("doc_tokens bigint, _full array<bigint>, _rest_crc bigint, _rest binary").fields])
    return rows.mapInArrow(encode, schema)
