"""BPE encoding and decoding over a table of distinct words.

Texts are split in Spark tasks into the pieces that a tokenizer's pre-tokenizer makes. A run of documents (a slice) has its distinct words and, per document, the positions of
its words among these. Words of all slices meet by word, where each distinct word is encoded once; its ids come back to each slice by position, whatever the number of words.
They travel in buckets by a digest of the word: what a slice has in one bucket is one row of words and comes back as one row of ids, in the same order, so that no word carries a name or a number of its own.
There is one plan at every size, and no text is shuffled or written. Words and positions come from two passes over the texts, as writing both down takes more disk than reading
twice takes time. A slice is named by a digest of its words, so passes over rows in another order cannot be mistaken for one another: they end in an error. Tables read from files, and
stored or cached ones, keep their order.

Decoding joins ids with the table of pieces, once per distinct word of a slice where the tokenizer has no decoder, as the default one, and pieces are joined by spaces; a tokenizer with
a decoder is called with the pieces of the whole text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, whole

SLICE_BYTES = 4 << 20  # text of a slice, about; a longer document is a slice of its own
BUCKETS = 1024
#: A bucket with more distinct words has some of them encoded again instead of remembered.
REMEMBERED = 1 << 20
BETWEEN = b"\xff"  # in no UTF-8 text


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _loaded(definition: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    return made


def _parts(definition: str):
    """A tokenizer's parts: normaliser, pre-tokenizer, a model that takes one ready piece, and its special strings. Made once per task."""
    import json

    from tokenizers import Tokenizer

    made, plain = _loaded(definition), json.loads(definition)
    model = Tokenizer(made.model)
    special = {t["content"]: t["id"] for t in plain["added_tokens"]}
    at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
    return made.normalizer, made.pre_tokenizer, model, special, at_special


def _classes() -> tuple[str, str]:
    """Letters and digits below U+0130 as character classes; there all Unicode versions agree."""
    def chars(kind: str) -> str:
        return "".join(re.escape(chr(i)) for i in range(0x130) if unicodedata.category(chr(i))[0] == kind)

    return chars("L"), chars("N")


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}
LATIN = re.compile("[^\\x00-\\u012f]")
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Splitter:
    """Cuts a text into pieces as a tokenizer's normaliser and byte-level pre-tokenizer do.

    For texts below U+0130 and the one
    splitting pattern named above an equal regular expression is used, as the library's own calls are slow; any other
    text or tokenizer goes through the library.
    """

    def __init__(self, definition: str):
        import json

        self.normalizer, self.pre_tokenizer, _, self.special, self.at_special = _parts(definition)
        plain = json.loads(definition)
        steps = (plain.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norms = [x.get("type") for x in (plain.get("normalizer") or {}).get("normalizers", [])]
        self.fast = None
        if norms == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLIT_PATTERN} and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            letters, digits = _classes()
            space = r"\x09-\x0d\x20\x85\xa0"
            self.fast = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")

    def plain(self, text: str) -> list[str]:
        """Pieces of a text without special strings."""
        if self.fast is not None and not LATIN.search(text):
            return self.fast.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [bytes(map(CHAR_BYTES.__getitem__, piece)).decode("utf-8") for piece, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        """Pieces as raw strings. A special string, which no piece can equal, stands for itself."""
        if self.at_special is None or not self.at_special.search(text):
            return self.plain(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out.extend(self.plain(part))
        return out


class Encoder:
    """Ids and decoded text of single words."""

    def __init__(self, definition: str):
        _, _, model, self.special, _ = _parts(definition)
        self.model = model.model
        made = _loaded(definition)
        self.names, self.decoder = {i: t for t, i in made.get_vocab(with_added_tokens=True).items()}, made.decoder

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize("".join(map(BYTE_CHARS.__getitem__, word.encode())))]

    def pieces(self, ids: list[int]) -> list[str]:
        """The join of ids with the table of pieces; an id without one has no piece."""
        return [self.names[i] for i in ids if i in self.names]


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as their lowest bytes, then their next ones, and so on: bytes that are mostly zero lie together."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _packed(numbers: np.ndarray) -> bytes:
    return pa.compress(_planes(numbers), codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer, size: int) -> np.ndarray:
    return _numbers(pa.decompress(data, 4 * size, codec="zstd", asbytes=True) if size else b"")


def _by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings words of one bucket together, the buckets met, and where each begins in that order."""
    order = np.argsort(buckets, kind="stable")
    met, starts = np.unique(buckets[order], return_index=True)
    return order, met, np.append(starts, len(order))


class _Slice:
    """Documents that are written as one row."""

    def __init__(self):
        self.rows, self.counts, self.at, self.words = [], [], [], {}
        self.size = 0

    def add(self, row: dict, words: list[str], size: int) -> None:
        known = self.words
        self.at.append(np.array([known.setdefault(w, len(known)) for w in words], np.uint32))
        self.rows.append(row)
        self.counts.append(len(words))
        self.size += size

    def name(self) -> tuple[int, int]:
        """128 bits that stand for the list of words."""
        import xxhash

        found = xxhash.xxh3_128_intdigest("\0".join(self.words).encode())
        return (found >> 64) - (1 << 63), (found & (1 << 64) - 1) - (1 << 63)

    def batch(self, kind: pa.DataType, with_words: bool) -> pa.RecordBatch:
        s1, s2 = self.name()
        words = [w.encode() for w in self.words]
        buckets = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % BUCKETS
        if with_words:
            order, met, edges = _by_bucket(buckets)
            words = [words[i] for i in order.tolist()]
            runs = [BETWEEN.join(words[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array([s1] * len(met), pa.int64()), pa.array([s2] * len(met), pa.int64()), pa.array(met.astype(np.int32)), pa.array(runs, pa.binary())], names=["s1", "s2", "bucket", "words"])
        # a word is 0 where it is new, else its number plus 1; frequent words come early and have small numbers
        at = np.concatenate([np.zeros(0, np.uint32), *self.at]).astype(np.int64)
        new = at > np.maximum.accumulate(np.concatenate([[-1], at]))[:-1]
        places = _packed(np.where(new, 0, at + 1))
        return pa.RecordBatch.from_arrays([pa.array([s1], pa.int64()), pa.array([s2], pa.int64()), pa.array([self.rows], pa.list_(kind)), pa.array([self.counts], pa.list_(pa.int32())),
                                           pa.array([places], pa.binary()), pa.array([len(words)], pa.int32()), pa.array([_packed(buckets)], pa.binary())], names=["s1", "s2", "rows", "counts", "places", "n_words", "buckets"])


def sliced(rows: DataFrame, definition: str, slice_bytes: int, with_words: bool) -> DataFrame:
    """Slices of `rows` (a struct `row`, and `text`): their name (s1, s2) and either their words, a row for each bucket, or their rows, words per row, places of all words, and number and buckets of the distinct ones."""
    from pyspark.sql import types as T

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, made, kind = Splitter(definition), _Slice(), None
        for batch in batches:
            kind = batch.schema.field("row").type
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                if made.rows and made.size + len(text) > slice_bytes:
                    yield made.batch(kind, with_words)
                    made = _Slice()
                made.add(row, split(text), len(text))
        if made.rows:
            yield made.batch(kind, with_words)

    name = [T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())]
    words = [T.StructField("bucket", T.IntegerType()), T.StructField("words", T.BinaryType())]
    places = [T.StructField("rows", T.ArrayType(rows.schema["row"].dataType)), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("places", T.BinaryType()),
              T.StructField("n_words", T.IntegerType()), T.StructField("buckets", T.BinaryType())]
    return rows.mapInArrow(cut, T.StructType(name + (words if with_words else places)))


def word_ids(slices: DataFrame, definition: str) -> DataFrame:
    """(s1, s2, bucket, ids) of the words of every slice and bucket: a bucket of the corpus is in one task, where each distinct word is encoded once, however many slices have it.
    `ids` tells how many ids each word has, then the ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, known = Encoder(definition), None, {}
        for batch in batches:
            out = []
            for bucket, run in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != last or len(known) > REMEMBERED:
                    known, last = {}, bucket
                words = run.split(BETWEEN)
                for word in words:
                    if word not in known:
                        known[word] = np.array(encoder.ids(word.decode()), "<u4").tobytes()
                found = [known[word] for word in words]
                out.append(_planes(np.fromiter(map(len, found), np.int64, len(found)) // 4) + _planes(np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("s1", "s2", "bucket")), pa.array(out, pa.binary())], names=["s1", "s2", "bucket", "ids"])

    return slices.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode, "s1 long, s2 long, bucket int, ids binary")


def encoded(docs: DataFrame, definition: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`row` (all columns of `docs` but its text), with `ids` (binary: little-endian unsigned 32 bits each) and `decoded` of the whole text."""
    from pyspark.sql import types as T

    # a slice is a row of some megabytes, so batches are bounded in bytes as well as in rows
    inner = bounded_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), whole().alias("text"))
    found = word_ids(sliced(inner, definition, slice_bytes, True), definition).groupBy("s1", "s2").agg(F.collect_list(F.struct("bucket", "ids")).alias("found"))
    met = sliced(inner, definition, slice_bytes, False).join(found, ["s1", "s2"], "left").select("rows", "counts", "places", "n_words", "buckets", "found")
    return met.mapInArrow(_joined(definition), T.StructType([inner.schema["row"], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))


def _ids_of_words(buckets: np.ndarray, found: pa.Array | None) -> np.ndarray:
    """The ids of every word of a slice, by its number; `found` has what came back for each bucket."""
    order, met, edges = _by_bucket(buckets)
    # slices of equal words have one name, so a bucket may have come back more than once
    came = dict(zip(found.field("bucket").to_pylist(), found.field("ids").to_pylist())) if found is not None else {}
    if list(came.keys() - set(met.tolist())) or len(came) != len(met):
        raise ValueError("the table gave its rows in another order when it was read again: store it before encoding")
    ids = np.empty(len(order), object)
    for bucket, a, b in zip(met.tolist(), edges.tolist(), edges[1:].tolist()):
        data, k = came[bucket], 4 * (b - a)
        ends = 4 * np.cumsum(_numbers(data[:k]), dtype=np.int64)
        whole_run = _numbers(data[k:]).tobytes()
        for i, start, end in zip(order[a:b].tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            ids[i] = whole_run[start:end]
    return ids


def _joined(definition: str):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(definition)
        for batch in batches:
            for n in range(batch.num_rows):
                rows, counts, found = batch.column("rows")[n].values, batch.column("counts")[n].as_py(), batch.column("found")[n].values
                places = _unpacked(batch.column("places")[n].as_buffer(), sum(counts)).astype(np.int64) - 1
                new = places < 0
                places[new] = np.arange(int(new.sum()))
                ids = _ids_of_words(_unpacked(batch.column("buckets")[n].as_buffer(), batch.column("n_words")[n].as_py()), found)
                texts = None
                if encoder.decoder is None:
                    texts = np.array([" ".join(encoder.pieces(np.frombuffer(x, "<u4").tolist())) for x in ids], object)
                out_ids, out_texts, start = [], [], 0
                for count in counts:
                    at = places[start : start + count]
                    start += count
                    out_ids.append(b"".join(ids[at].tolist()))
                    if texts is not None:
                        out_texts.append(" ".join(filter(None, texts[at].tolist())))
                    else:
                        out_texts.append(encoder.decoder.decode(encoder.pieces(np.frombuffer(out_ids[-1], "<u4").tolist())))
                yield pa.RecordBatch.from_arrays([rows, pa.array(out_ids, pa.binary()), pa.array(out_texts, pa.string())], names=["row", "ids", "decoded"])

    return join


def definition_of(path: str) -> str:
    """The tokenizer file's content, read on the driver; tasks get it with their code."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def bpe(docs: DataFrame, path: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of `docs`.

    Null and empty texts, and texts of white space, have no tokens and the digests of nothing. Texts of any length are encoded whole. Repeated rows give repeated results,
    extra columns are not read, an empty table gives no rows. The table is read twice and has to give its rows in one order, as files and stored tables do.
    """
    out = encoded(docs.select("doc_id", "text"), definition_of(path or tokenizer_file()), slice_bytes)
    return out.select("row.doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
