"""Operator 8: SentencePiece encoding and decoding by the tokenizers library, rebuilt from the model file and checked against the original library."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

#: Threads of the library in each task; it would start one for each core of the machine, whatever the task's share is.
os.environ.setdefault("RAYON_NUM_THREADS", "2")

import sentencepiece  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql.types import ArrayType, BooleanType, IntegerType  # noqa: E402
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers  # noqa: E402

from . import piece_model  # noqa: E402
from .common import arrow_ready, as_bytes, chunks, map_batches, read  # noqa: E402
from .piece_model import MARK  # noqa: E402

#: Where the model file is, unless a caller or the environment names another.
MODEL_PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _merges(plain: dict[str, int], pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best-scored result first."""
    found = []
    for piece, k in plain.items():
        own = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in plain and piece[i:] in plain]
        found += [(-pieces[k][1], k, plain[a], plain[b], a, b) for a, b in own]
    return [x[4:] for x in sorted(found)]


@lru_cache(maxsize=4)
def build(data: bytes) -> Tokenizer:
    """A tokenizer with the model's normaliser, white space mark, scores and byte fallback. Special pieces are never made from text."""
    model = piece_model.parse(data)
    plain, pieces = model.plain(), model.pieces
    if any(kind == piece_model.USER_DEFINED for *_, kind in pieces):
        raise ValueError("models with user-defined pieces are not supported: the library would split them")
    if model.kind == piece_model.BPE:
        vocab = {p: k for k, (p, _, _) in enumerate(pieces)}
        core = models.BPE(vocab, _merges(plain, pieces), unk_token=pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s if kind in (piece_model.NORMAL, piece_model.USER_DEFINED) else 0.0) for p, s, kind in pieces], model.unknown, model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if model.splits_before_mark:  # then words can be looked up in the library's cache
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(pieces[model.unknown][0], model.unknown_surface), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


@lru_cache(maxsize=4)
def original(data: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=data)


#: Words whose ids a task remembers; beyond it starts anew, so its memory stays bounded.
REMEMBERED = 250_000
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Words:
    """What a task knows of the words it has met: their ids as little-endian 32-bit numbers, and which of them the original library encodes differently or decoding doesn't give back."""

    def __init__(self, data: bytes):
        self.data, self.model, self.whole = data, piece_model.parse(data), build(data)
        self.bare = Tokenizer.from_str(self.whole.to_str())
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([])
        self.ids: dict[str, bytes] = {}
        self.differing: set[str] = set()
        self.lossy: set[str] = set()

    def cut(self, text: str) -> list[str]:
        """A text's words, each with the white space marks before it."""
        if self.model.charsmap or self.model.squeeze:
            normal = self.whole.normalizer.normalize_str(text)
        else:
            normal = ((MARK if self.model.dummy_prefix else "") + text if text else "").replace(" ", MARK)
        if not self.model.splits_before_mark:
            return [normal] * bool(normal)
        if normal[:1] == MARK and normal[-1] != MARK and MARK + MARK not in normal:
            return normal[1:].split(MARK)  # the usual case: one mark before each word, which is then left out
        return [x[1:] if len(x) > 1 and x[0] == MARK != x[1] else MARK + x for x in SEGMENT.findall(normal)]

    def learn(self, words: list[list[str]], verify: bool) -> None:
        """Encodes the distinct words that are new, by the threads of the library; compares and decodes each of them once."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear(), self.differing.clear(), self.lossy.clear()
        new = list(set().union(*words).difference(self.ids))
        # a word that isn't preceded by just one mark has a further mark in front to tell it by
        full = [w[1:] if w[:1] == MARK else MARK + w for w in new] if self.model.splits_before_mark else new
        ids = [e.ids for e in self.bare.encode_batch_fast(full, add_special_tokens=False)]
        self.ids.update(zip(new, (array("I", x).tobytes() for x in ids), strict=True))
        if verify:
            plain = [f[1:] if self.model.dummy_prefix and f[:1] == MARK else f for f in full]
            theirs = original(self.data).encode(plain, num_threads=1)
            self.differing.update(w for w, p, x, y in zip(new, plain, theirs, ids, strict=True) if x != y and p)
            self.lossy.update(new[k] for k in self.not_given_back(ids, plain))


    def not_given_back(self, ids: list[list[int]], plain: list[str], together: int = 256) -> list[int]:
        """Places of the words that decoding doesn't give back. Words are decoded many at a time; only where the whole differs, one by one."""
        wrong = []
        for a in range(0, len(ids), together):
            own = range(a, min(a + together, len(ids)))
            if self.model.splits_before_mark and self.model.dummy_prefix:
                whole = self.whole.decode(list(chain.from_iterable(ids[k] for k in own)), skip_special_tokens=False)
                if whole == " ".join(plain[k] for k in own).replace(MARK, " "):
                    continue
            wrong += [k for k in own if self.whole.decode(ids[k], skip_special_tokens=False) != plain[k].replace(MARK, " ")]
        return wrong


@lru_cache(maxsize=4)
def words_of(data: bytes) -> Words:
    return Words(data)


def encoded(texts: list[str], data: bytes, verify: bool = False) -> Iterator[tuple[bytes, bool, bool]]:
    """Of each text: its ids as little-endian 32-bit numbers, whether the original library gives the same, and whether decoding gives the text back (both true where `verify` is not asked for).

    Where no piece reaches over a white space mark, nothing in either library joins over one: a text is then cut into words, and each distinct word is encoded, compared and decoded once. For models of merges this is exact. A
    unigram model chooses between equally good cuttings by sums over the whole text, which rounding makes differ from those over a word: there each whole text is compared with the original's ids."""
    known = words_of(data)
    sums = verify and known.model.kind != piece_model.BPE
    for a, b in chunks([t.encode() for t in texts], 1 << 20):
        cut = [known.cut(t) for t in texts[a:b]]
        known.learn(cut, verify)
        same, whole = not known.differing, not known.lossy
        theirs = original(data).encode(texts[a:b], num_threads=1) if sums else [None] * (b - a)
        for text, words, other in zip(texts[a:b], cut, theirs, strict=True):
            plain = MARK not in text and not known.model.charsmap and not known.model.squeeze
            ids = b"".join(map(known.ids.__getitem__, words))
            alike = np.frombuffer(ids, "<u4").tolist() == other if sums else same or known.differing.isdisjoint(words)
            yield ids, alike, plain and (whole or known.lossy.isdisjoint(words))


def encode(texts: list[str], data: bytes) -> list[list[int]]:
    return [np.frombuffer(x, "<u4").tolist() for x, *_ in encoded(texts, data)]


def decode(ids: list[list[int]], data: bytes) -> list[str]:
    return build(data).decode_batch(ids, skip_special_tokens=False)


def tokenised(docs: DataFrame, data: bytes) -> DataFrame:
    """The rows of docs with token_ids, the ids of their text, round_trip (decoding them gives the text back) and parity (the original library gives the same ids): null for a null text, no ids for an empty one.
    Columns of docs that have these names, in any case, are replaced; very long texts are encoded whole; repeated rows each give a row; an empty table gives no rows."""
    arrow_ready(docs.sparkSession, 128)
    columns = [c for c in docs.columns if c.lower() not in ("token_ids", "round_trip", "parity")]
    schema = docs.select(*columns).schema.add("token_ids", ArrayType(IntegerType())).add("round_trip", BooleanType()).add("parity", BooleanType())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else t.decode("utf-8", "replace") for t in batch["text"].cast(pa.binary()).to_pylist()]
        found = encoded([t for t in texts if t is not None], data, verify=True)
        rows = [(None, None, None) if t is None else next(found) for t in texts]
        ids = pa.array([None if x is None else np.frombuffer(x, "<i4") for x, *_ in rows], pa.list_(pa.int32()))
        more = [pa.array([r[k] for r in rows], pa.bool_()) for k in (2, 1)]
        return pa.RecordBatch.from_arrays([*batch.columns, ids, *more], names=[*batch.schema.names, "token_ids", "round_trip", "parity"])

    return map_batches(docs.select(*columns), run, schema)


def digests(docs: DataFrame, data: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (decoding gives the text back; a text that holds the white space mark itself has none) and parity (the original
    library gives the same ids) of each row.
    A null or empty text has no tokens; very long texts are encoded whole; bytes that aren't UTF-8 count as the replacement character; repeated rows each give a row; further columns are ignored; an empty table gives no
    rows."""
    arrow_ready(docs.sparkSession, 128)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.decode("utf-8", "replace") for t in batch["text"].to_pylist()]
        found = list(encoded(texts, data, verify=True))
        sums = [hashlib.sha256(x).hexdigest() for x, *_ in found]
        columns = [batch["doc_id"].cast(pa.int64()), pa.array([len(x) // 4 for x, *_ in found], pa.int64()), pa.array(sums, pa.string()), pa.array([r for *_, r in found], pa.bool_()), pa.array([p for _, p, _ in found], pa.bool_())]
        return pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"])

    return map_batches(docs.select("doc_id", as_bytes().alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean")


def query(spark: SparkSession, sf_dir: str, path: str = MODEL_PATH) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), piece_model.load(path))
