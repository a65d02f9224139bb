"""Token ids as Parquet list columns: delta-encoded, in small row groups with page indexes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import by_bytes, kept_in_worker, new_path, ref, take_lists

END_ID = 1
#: Parquet: rows of about this many bytes make a row group, and a page holds this many bytes.
ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 64 << 10
_MARKS = ".,;:!?)]}-"
#: Letters that Unicode's composed form (NFC) leaves as they are and that are one letter in lower case too.
_LETTERS = ("^[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u0233]+$")
#: The tokenizer's pattern on lower-cased ASCII without white space.
_ASCII_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class BatchEncoder:
    """The library's ids of whole texts, a batch at a time, each distinct piece of a word encoded once.

    For tokenizers that drop white space and join nothing across it (BPE with word ends):
    a text's ids are those of its words one after another. Arrow splits the texts and finds
    the distinct words. One that is letters and then marks, and any other plain ASCII word, is cut into the
    pieces that the tokenizer's own pattern gives; the library encodes many pieces at once,
    each ending in one token with the word-end suffix. Any other word goes to the library whole.
    Nothing is kept from batch to batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model, for pieces that are normalised and cut already
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and their offsets."""
        flat = []
        for k in range(0, len(pieces), 200):
            part = pieces[k : k + 200]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            if int(self.ends[ids].sum()) != len(part):
                raise RuntimeError("pieces don't end in one word end each: the tokenizer isn't of the kind that this class is for")
            flat.append(ids)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        return flat, np.concatenate(([0], np.flatnonzero(self.ends[flat]) + 1))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and their offsets."""
        cores = pc.utf8_rtrim(words, characters=_MARKS)
        lettered = pc.match_substring_regex(cores, _LETTERS).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(cores.filter(pa.array(lettered))).dictionary_encode()
        raw, sizes = words.filter(pa.array(lettered)), pc.utf8_length(cores.filter(pa.array(lettered))).to_numpy()
        whole_sizes = pc.utf8_length(raw).to_numpy()
        tails = np.flatnonzero(whole_sizes > sizes)  # few: words with marks after them
        tail = [w[n:] for w, n in zip(raw.take(pa.array(tails)).to_pylist(), sizes[tails].tolist())]
        pieces = low.dictionary.to_pylist()
        number = {p: k for k, p in enumerate(pieces)}
        odd, alone = [], []
        for w in words.filter(pa.array(~lettered)).to_pylist():
            plain = w.isascii() and "<|" not in w
            odd.append(_ASCII_PIECE.findall(w.lower()) if plain else None)
            if not plain:
                alone.append(w)
        for p in {*tail, *(p for own in odd if own for p in own)}:
            number.setdefault(p, len(number))
        flat, offsets = self._pieces(list(number))
        extra = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        base = len(number)
        offsets = np.concatenate((offsets, offsets[-1] + np.cumsum([len(x) for x in extra], dtype=np.int64))) if extra else offsets
        flat = np.concatenate((flat, *extra)) if extra else flat
        # pieces of each word
        counts = np.ones(len(words), np.int64)
        at_lettered, at_odd = np.flatnonzero(lettered), np.flatnonzero(~lettered)
        counts[at_lettered[tails]] = 2
        counts[at_odd] = [1 if own is None else len(own) for own in odd]
        ends = np.concatenate(([0], np.cumsum(counts)))
        own = np.zeros(ends[-1], np.int64)
        own[ends[at_lettered]] = low.indices.to_numpy()
        own[ends[at_lettered[tails]] + 1] = [number[p] for p in tail]
        k = base
        for at, cut in zip(ends[at_odd].tolist(), odd):
            if cut is None:
                own[at] = k
                k += 1
            elif cut:
                own[at : at + len(cut)] = [number[p] for p in cut]
        got, piece_ends = take_lists(flat, offsets, own)
        return got, piece_ends[ends]

    def __call__(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """A list of ids for each text, with end_id after it."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, offsets = self._words(coded.dictionary)
        ids, ends = take_lists(flat, offsets, coded.indices.to_numpy().astype(np.int64))
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, ordered: bool = False) -> DataFrame:
    """(doc_id, tokens array<int>, part, row): the library's ids of each whole text, then end_id. Null text: as empty. Repeated rows stay.

    ordered: texts are first dealt out and sorted by ascending doc_id, null ids first, so
    that part k holds lower ids than part k + 1 and row ascends with them; ties keep their
    order in the input and spread over parts.
    """
    texts = docs.select(ref(id_col).cast("long").alias("doc_id"), F.coalesce(ref(text_col), F.lit("")).alias("text"))
    if ordered:
        texts = texts.withColumn("place", F.monotonically_increasing_id()).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    texts = texts.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(("words", path), lambda: BatchEncoder(path))
        for b in batches:
            for part in by_bytes(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), encode(part.column("text"), end_id), part.column("part"), part.column("row")], ["doc_id", "tokens", "part", "row"])

    return texts.mapInArrow(run, "doc_id long, tokens array<int>, part int, row long")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> None:
    """Write the ids of docs in ascending doc_id order to Parquet files.

    The files are Parquet format 2: ids bit-packed as deltas (DELTA_BINARY_PACKED), small
    row groups and pages, with column and offset indexes, so that a reader of some ids,
    or of metadata only (n_tokens), skips the rest. Spark's writer commits the files, so a
    lost task leaves nothing behind.
    """
    tokens = encode_tokens(docs, tokenizer, id_col, text_col, end_id, ordered=True)
    writer = tokens.select("doc_id", "tokens", F.size("tokens").cast("long").alias("n_tokens"), "part", "row").write
    writer = writer.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("compression", "zstd")
    writer.option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES)).option("parquet.page.row.count.limit", "1000").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, part, row) of a folder of token files; row ascends with doc_id over all files."""
    return spark.read.schema("doc_id long, tokens array<int>, n_tokens long, part int, row long").parquet(path)


def token_starts(read: DataFrame) -> DataFrame:
    """(row, start): the number of ids before each row, from the metadata columns alone.

    Sums of the parts (a row for each) give offsets; a running sum inside a part the rest.
    """
    meta = read.select("part", "row", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row")
    return meta.withColumn("own", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(F.broadcast(parts), "part").select("row", (F.col("base") + F.col("own")).alias("start"))


def token_digests(read: DataFrame) -> DataFrame:
    """(row, doc_id, n_tokens, ids_crc32) of the ids read: crc32 over them as little-endian 32-bit integers."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array((ends[1:] - ends[:-1]).astype(np.int64)), pa.array(sums, pa.int64())], ["row", "doc_id", "n_tokens", "ids_crc32"])

    return read.select("row", "doc_id", "tokens").mapInArrow(run, "row long, doc_id long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs, write the token files to the shared folder, read them back: (doc_id, start, n_tokens, ids_crc32).

    An empty table gives files without rows and an empty result.
    """
    spark, out = docs.sparkSession, new_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, path, id_col, text_col)
    read = read_tokens(spark, out)
    return token_digests(read).join(token_starts(read), "row").select("doc_id", "start", "n_tokens", "ids_crc32")
