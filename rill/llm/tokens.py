"""Tokens of public vocabularies: counting them, and encoding for packing.

Counting (``count_tokens``): Arrow batches are regrouped into calls of about equal bytes; texts longer than
``LONG_CHARS`` are split where the tokenizer cannot join tokens: at a single space between two ASCII letters.
Only lengths leave the function. A null text counts as empty: no bytes, no tokens; repeated rows get a row each; a null id stays null;
an empty table gives an empty table; other columns are left alone.

Encoding (``WordEncoder``): a vocabulary that drops white space and never joins across it encodes a text as the
sequence of its chunks between white space, so each distinct chunk is encoded once and kept in a bounded cache.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, settled, ship, slices, tokenizer_path

CALL_BYTES = 400_000
BATCH_BYTES = 4_000_000
#: Chunks that a word encoder keeps, some 150 bytes each.
CACHED = 800_000
LONG_CHARS = 40_000
#: A space that no token of a white-space-splitting vocabulary spans.
SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def split_safely(text: str, most: int = LONG_CHARS) -> list[str]:
    """Parts of at least ``most`` characters (the last: any) whose token counts add up to the text's.

    The space at a cut is dropped, as the tokenizer puts one before each part. A text without a safe boundary stays whole.
    """
    parts, at = [], 0
    while len(text) - at > most:
        m = SAFE.search(text, at + most)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.end()
    parts.append(text[at:])
    return parts


def batch_counter(vocabulary: str):
    """A function from a list of texts to their token counts, by the library that reads the vocabulary file."""
    path = tokenizer_path(vocabulary)
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x) for x in t.encode_batch(texts, add_special_tokens=False)]


def count_batches(
    batches: Iterator[pa.RecordBatch], vocabulary: str, call_bytes: int = CALL_BYTES, long_chars: int = LONG_CHARS
) -> Iterator[pa.RecordBatch]:
    count = batch_counter(vocabulary)
    cut = vocabulary.endswith(".model")
    for batch in slices(batches, 1, BATCH_BYTES):
        ids = batch.column(0)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        owner, parts = [], []
        for i, t in enumerate(texts):
            own = split_safely(t, long_chars) if cut and len(t) > long_chars else [t]
            parts += own
            owner += [i] * len(own)
        lengths = np.zeros(len(texts), np.int64)
        for i, j in by_bytes(parts, call_bytes):
            np.add.at(lengths, owner[i:j], count(parts[i:j]))
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes), pa.array(lengths)], schema=_COUNTS)


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each whole text; one row for each row, no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        yield from settled(count_batches(batches, vocabulary))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")


class WordEncoder:
    """Token ids as little-endian 32-bit bytes, chunk by chunk, for vocabularies of lower case that drop white space and
    mark the ends of words."""

    WORD_END = "</w>"
    MARKS = frozenset(",.")
    #: Words that are encoded as one text.
    JOINED = 1000

    def __init__(self, vocabulary: str, most: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.most = most
        self.cache: dict[str, bytes] = {}
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for n, i in names.items() if n.endswith(self.WORD_END)]] = True

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Of words that are letters only: many at once, told apart by the tokens that end words."""
        out: list[bytes] = []
        for i in range(0, len(words), self.JOINED):
            own = words[i : i + self.JOINED]
            body = self.encode_plain([" ".join(own)])[0]
            last = np.flatnonzero(self.ends[np.frombuffer(body, "<u4")])
            if len(last) != len(own):
                out += self.encode_plain(own)
                continue
            cuts = [0, *((last + 1) * 4).tolist()]
            out += [body[a:z] for a, z in zip(cuts, cuts[1:])]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of new chunks into the cache. A final comma or period after a letter is a token of its own."""
        cache = self.cache
        ended = [c for c in chunks if c[-1:] in self.MARKS and c[:-1].isalpha() and (c.isascii() or plain(c))]
        new = [c for c in chunks.difference(ended).union([c[:-1] for c in ended], ",.") if c not in cache]
        words = [c for c in new if c.isalpha() and (c.isascii() or plain(c))]
        cache.update(zip(words, self.encode_words(words)))
        rest = [c for c in new if c not in cache] if len(words) < len(new) else []
        for i in range(0, len(rest), 20_000):
            cache.update(zip(rest[i : i + 20_000], self.encode_plain(rest[i : i + 20_000])))
        for c in ended:
            cache[c] = cache[c[:-1]] + cache[c[-1]]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has. Memory goes with the texts of one call.

        ASCII letters are lower-cased at once, but not where a special token could begin; then each distinct chunk of a
        call is looked up once.
        """
        low = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        parts = pc.ascii_split_whitespace(low)
        coded = parts.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, chunks))
        if None in found:
            new = {c for c, f in zip(chunks, found) if f is None}
            if len(self.cache) + len(new) > self.most:
                self.cache = dict(islice(self.cache.items(), len(self.cache) // 2, None))
                new = set(chunks) - self.cache.keys()
            self.learn(new)
            found = list(map(self.cache.__getitem__, chunks))
        size = np.array([len(f) for f in found], np.int64) // 4
        start = np.cumsum(size) - size
        own = size[at]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(start[at] - (ends - own), own) + np.arange(total)
        ids = np.frombuffer(b"".join(found), "<u4")[place]
        counts = np.diff(np.concatenate(([0], ends))[parts.offsets.to_numpy() - parts.offsets[0].as_py()])
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[z - n : z].tobytes() for z, n in zip(ends, counts)]


#: Characters that are lower-cased the same everywhere and never compose, without the one that special tokens begin with.
PLAIN = re.compile("[\x00-;=-\xff]*")


def plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None


_encoders: dict[tuple[str, int], WordEncoder] = {}


def word_encoder(vocabulary: str, most: int = CACHED) -> WordEncoder:
    """One encoder for each Python worker: its cache serves task after task."""
    if (vocabulary, most) not in _encoders:
        _encoders.clear()
        _encoders[vocabulary, most] = WordEncoder(vocabulary, most)
    return _encoders[vocabulary, most]
