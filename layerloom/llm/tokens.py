"""Token counts through a cache of content digests.

A text's key is the digest of its normalised content together with the digest of the tokenizer (its file, library
version and options). Texts whose key the cache holds are not encoded; of the others each distinct text is encoded once
and its count is appended to the cache. Digests meet the cache first; then the texts of what it lacks move between
executors, and nothing does where it lacks nothing. A folder that is kept serves later runs.

Normalisation may only join what has equal counts, so by default it only makes null an empty text.

Inside a task, texts are cut before single spaces, where no pre-token of a byte-level tokenizer spans, and the library
encodes each distinct piece once (``PieceMemo``), a piece as ``word,`` in two parts that other pieces share. A text with white space after a space, where a cut could change the
pre-tokens, or with an added token in it goes to the library whole, and so do all texts of other kinds of tokenizers.

Cases: null counts as empty, with 0 tokens; repeated rows each get a row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.llm.common import byte_hash, in_arrow, packed, ranges, scratch_dir, slices, span_hash, written

LIMIT = 1024
CACHE = "tokenizer string, digest binary, n_tokens long"
#: Pieces that a worker remembers; some 60 bytes each.
MEMO = 500_000
#: A space before white space or the end: a cut there could change the pre-tokens.
_UNSAFE = r" ([\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"

_LETTER, _OTHER = np.zeros(256, bool), np.ones(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER[128:] = False
_OTHER[_LETTER] = False


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Digest of what determines a count: the file, the library's version and the options."""
    import sentencepiece
    import tokenizers

    h = hashlib.sha256(f"tokenizers {tokenizers.__version__} sentencepiece {sentencepiece.__version__} no added tokens".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


class PieceMemo:
    """Encodes texts with the library, each distinct piece between spaces once; a piece's ids stand in one array with all others."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.forget()
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.cuts = False
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.encode = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path) as f:
            spec = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.cuts = plain.items() <= (spec.get("pre_tokenizer") or {}).items() and not spec.get("normalizer")
        # in a byte-level vocabulary a token that begins with a space is written with this letter
        self.begins = np.array([(library.id_to_token(i) or "").startswith("\u0120") for i in range(library.get_vocab_size())], bool)

    def forget(self, keep: int = 0) -> None:
        """Only the first ``keep`` pieces stay: those met first are mostly the frequent ones."""
        self.tails: dict[bytes, list[int]] = {}
        if not keep:
            self.words = pa.array([], pa.large_binary())  # without the space before them
            self.key, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by hash: where it is
            self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
            return
        stays = self.place < keep
        self.key, self.place = self.key[stays], self.place[stays]
        self.words = pa.concat_arrays([self.words[:keep]])
        self.at = self.at[: keep + 1].copy()
        self.ids = self.ids[: self.at[-1]].copy()

    def values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's ids."""
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        whole = np.ones(len(texts), bool) if not self.cuts else np.logical_or.reduce([pc.match_substring_regex(column, _UNSAFE).to_numpy(False), *(pc.match_substring(column, a).to_numpy(False) for a in self.added)])
        pieces = pc.split_pattern(column.filter(pa.array(~whole)), " ")
        n_pieces = np.ones(len(texts), np.int64)
        n_pieces[~whole] = pc.list_value_length(pieces).to_numpy()
        flat, heads = pieces.flatten(), pieces.offsets.to_numpy()[:-1] - (pieces.offsets[0].as_py() if len(pieces) else 0)
        rest = np.ones(len(flat), bool)
        rest[heads] = False  # the first piece of a text has no space before it
        words = flat.filter(pa.array(rest)).dictionary_encode()
        known, at = self._ids(words.dictionary.cast(pa.large_binary()))
        lead: list[str] = [""] * len(texts)
        for i, t in zip(np.flatnonzero(~whole).tolist(), flat.take(pa.array(heads)).to_pylist()):
            lead[i] = t
        for i in np.flatnonzero(whole).tolist():
            lead[i] = texts[i].decode()
        first = self.encode(lead)
        n_first = np.fromiter(map(len, first), np.int64, len(first))
        pool = np.concatenate([known, np.fromiter(chain.from_iterable(first), np.uint32, int(n_first.sum()))])
        unit = np.concatenate(([0], np.cumsum(n_pieces)))[:-1]  # of each text, the place of its first piece
        start, n = np.zeros(int(n_pieces.sum()), np.int64), np.zeros(int(n_pieces.sum()), np.int64)
        start[unit], n[unit] = len(known) + np.cumsum(n_first) - n_first, n_first
        others = np.ones(len(start), bool)
        others[unit] = False
        word = words.indices.to_numpy()
        start[others], n[others] = at.take(word), np.diff(at).take(word)
        return pool[ranges(start, n)], np.add.reduceat(n, unit) if len(unit) else n

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words that follow a space, one after the other, and where each one's begin (one entry more)."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        key = _hashes(words)
        place = self._find(key)
        new = np.flatnonzero(place < 0)
        if len(self.words) + 2 * len(new) > MEMO:
            self.forget(MEMO // 2)
            place = self._find(key)
            new = np.flatnonzero(place < 0)
        if len(new):
            self._learn(words.take(pa.array(new)), key[new])
            place[new] = self._find(key[new])
        if not self.words.take(pa.array(place)).equals(words):  # a word has another one's hash
            return self._library(words)
        n = np.diff(self.at).take(place)
        return self.ids.take(ranges(self.at.take(place), n)), np.concatenate(([0], np.cumsum(n)))

    def _find(self, key: np.ndarray) -> np.ndarray:
        by = np.argsort(key)
        at = np.empty(len(key), np.int64)
        at[by] = np.searchsorted(self.key, key[by])
        found = np.append(self.key, np.uint64(0)).take(at) == key
        found &= at < len(self.key)
        return np.where(found, np.append(self.place, np.int32(-1)).take(at), -1)

    def _library(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = column.cast(pa.large_string()).to_pylist()
        got = self.encode([" " + " ".join(words[i : i + 500]) for i in range(0, len(words), 500)])
        ids = np.fromiter(chain.from_iterable(got), np.uint32)
        begins = np.flatnonzero(self.begins[ids])  # only a word's first token begins with a space
        if len(begins) != len(words):
            got = self.encode([" " + x for x in words])
            return np.fromiter(chain.from_iterable(got), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int64)
        return ids, np.append(begins, len(ids))

    def _learn(self, words: pa.Array, key: np.ndarray) -> None:
        """New words. A token never spans a letter of A-Z, a-z and another character of ASCII after it, so words are cut at the first such place."""
        data, starts, _ = _bytes(words)
        cut = np.flatnonzero(_LETTER[data[:-1]] & _OTHER[data[1:]]) + 1
        of = np.searchsorted(starts, cut, "right") - 1
        inside = cut != starts[of]
        of, first = np.unique(of[inside], return_index=True)
        cut = cut[inside][first]
        whole = np.ones(len(words), bool)
        whole[of] = False
        texts = words.take(pa.array(of)).to_pylist()
        sizes = (cut - starts[of]).tolist()
        heads = pa.array([t[:k] for t, k in zip(texts, sizes)], pa.large_binary())
        plain = pa.concat_arrays([words.filter(pa.array(whole)), heads]).unique()
        plain_key = _hashes(plain)
        lacking = np.flatnonzero(self._find(plain_key) < 0)
        if len(lacking):
            plain = plain.take(pa.array(lacking))
            self._add(plain, plain_key[lacking], *self._library(plain))
        if not len(of):
            return
        tails = [t[k:] for t, k in zip(texts, sizes)]
        unknown = [t for t in dict.fromkeys(tails) if t not in self.tails]
        self.tails.update(zip(unknown, self.encode([t.decode() for t in unknown])))
        distinct = {t: i for i, t in enumerate(dict.fromkeys(tails))}
        n_tail = np.array([len(self.tails[t]) for t in distinct], np.int64)
        pool = np.concatenate([self.ids, np.fromiter(chain.from_iterable(self.tails[t] for t in distinct), np.uint32)])
        tail, head = np.fromiter(map(distinct.__getitem__, tails), np.int64, len(tails)), self._find(_hashes(heads))
        start = np.stack([self.at[head], (len(self.ids) + np.cumsum(n_tail) - n_tail)[tail]], 1).reshape(-1)
        n = np.stack([self.at[head + 1] - self.at[head], n_tail[tail]], 1)
        self._add(words.take(pa.array(of)), key[of], pool[ranges(start, n.reshape(-1))], np.concatenate(([0], np.cumsum(n.sum(1)))))
        if len(self.tails) > MEMO // 8:
            self.tails.clear()

    def _add(self, words: pa.Array, key: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        by = np.argsort(key)
        to = np.searchsorted(self.key, key[by])
        self.key, self.place = np.insert(self.key, to, key[by]), np.insert(self.place, to, (len(self.words) + by).astype(np.int32))
        self.words = pa.concat_arrays([self.words, words])
        self.at = np.concatenate([self.at, len(self.ids) + at[1:]])
        self.ids = np.concatenate([self.ids, ids])


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, where each starts, and its length."""
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at[:-1] - at[0], np.diff(at)


def _hashes(words: pa.Array) -> np.ndarray:
    data, starts, lens = _bytes(words)
    return span_hash(byte_hash(data), starts, starts + lens)


_memos: dict[str, PieceMemo] = {}


def memo(path: str) -> PieceMemo:
    """One for each worker process, kept between tasks; its size is bounded by MEMO."""
    if path not in _memos:
        _memos[path] = PieceMemo(path)
    return _memos[path]


def forget() -> None:
    """Frees what this process remembers; it is made anew when asked for."""
    _memos.clear()


def counts(texts: list[bytes], path: str) -> np.ndarray:
    return memo(path).values(texts)[1]


def ids(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and the number of each text's ids."""
    return memo(path).values(texts)


class CountCache:
    """A table of (tokenizer, digest, n_tokens) in a shared folder; appending adds files."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_dir(spark)
        spark.createDataFrame([], CACHE).write.mode("append").parquet(self.path)

    def read(self, version: str) -> DataFrame:
        """One row for each digest, also where two runs have appended it at once."""
        return self.spark.read.schema(CACHE).parquet(self.path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame, version: str) -> None:
        rows.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: CountCache, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: bytes, tokens and whether they exceed ``limit``. The cache has all counts afterwards."""
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "body"):
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts(texts, tokenizer), pa.int64())], ["digest", "n_tokens"])

    misses = written(keyed.select("digest").distinct().join(cache.read(version), "digest", "left_anti"))
    n = misses.count()
    if n:
        texts = keyed.select("digest", "text")
        # where the misses are few, Spark broadcasts their digests and only their texts are packed
        few = n * 64 <= docs.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        lacking = packed(texts.join(misses, "digest", "left_semi")) if few else packed(texts).join(misses, "digest", "left_semi")
        cache.append(lacking.dropDuplicates(["digest"]).transform(in_arrow, encode, "digest binary, n_tokens long"), version)
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(cache.read(version), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
