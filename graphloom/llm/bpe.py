"""BPE encoding and decoding through a distinct-word table (operator 9).

Texts are cut into words as the tokenizer's pre-tokenizer does, vectorised over code points. A chunk of documents keeps its text as codes of its own distinct words; the
distinct words of all chunks meet by word hash, where each distinct word is encoded once, and its ids go back to the chunks that asked. There ids are joined to the
codes by position. Decoding joins ids to the pieces of the vocabulary, a table of fixed size, and puts the pieces of a document together.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import flagged, give_back, pack, partitions, read, same_spans, span_hashes, unpack


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies: as the package public_tokenizers says, or in /opt/tokenizers."""
    if importlib.util.find_spec("public_tokenizers") is not None:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return os.path.join("/opt/tokenizers", name)


TOKENIZER = vocabulary_file()
BATCH_CHARS = 1 << 20
CHUNK_CHARS = 1 << 23
#: Ranges of the distinct-word table; it grows with the input up to MAX_RANGES, as every chunk sends a row to every range.
RANGES_A_SPLIT, MAX_RANGES = 4, 1 << 15
L, N, O, S, END, UNKNOWN = 0, 1, 2, 3, 5, 9
_cache: dict = {}


def _ask(points: list[int]) -> list[int]:
    """Classes of code points, by what the library's pre-tokenizer joins them with."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut, out = ByteLevel(add_prefix_space=False, use_regex=True), [S] * len(points)
    for lead, kind in (("a", L), ("1", N), ("!", O)):
        for _, (a, b) in cut.pre_tokenize_str("".join(f"{lead}{chr(c)}\n" for c in points)):
            if a % 3 == 0 and b - a > 1:
                out[a // 3] = kind
    return out


def classes(cp: np.ndarray) -> np.ndarray:
    """Class of every code point: letter, number, white space or other, as the library itself takes them (its Unicode version may differ from Python's)."""
    if "classes" not in _cache:
        known = np.full(0x110000, UNKNOWN, np.uint8)
        known[0xD800:0xE000] = O  # lone surrogates, which no column of strings holds
        _cache["classes"] = known
    known = _cache["classes"]
    cls = known[cp]
    if (cls == UNKNOWN).any():
        new = np.unique(cp[cls == UNKNOWN])
        known[new] = _ask(new.tolist())
        cls = known[cp]
    return cls


def word_starts(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Flags at the first code points of words: contractions, runs of letters, numbers or others with the space before them, and white space."""
    n = len(cp)
    before = np.concatenate([[END], cls[:-1]])
    run = cls != before
    after_space = np.concatenate([[False], cp[:-1] == 0x20]) & (before == S)
    solid = run & (cls != S) & (cls != END)
    start = solid & ~after_space
    start |= run & (cls == S)
    last_space = np.flatnonzero(solid & (before == S)) - 1
    start[last_space] = True
    # 's 't 'm 'd 're 've 'll where the apostrophe begins a word and is alone
    at = np.flatnonzero(solid & ~after_space & (cp == 0x27))
    at = at[at + 1 < n]
    at = at[cls[at + 1] == L]
    one = cp[at + 1]
    two = cp[np.minimum(at + 2, n - 1)]
    two = np.where(at + 2 < n, two, 0)
    short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
    long_ = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
    hit = at[short | long_]
    width = np.where(short, 2, 3)[short | long_]
    start[hit + 1] = False
    nxt = hit + width
    nxt = nxt[nxt < n]
    start[nxt[cls[nxt] == L]] = True
    return start & (cls != END)


class Splitter:
    """Words of texts as codes; keeps the spelling of each new word in UTF-8. special: strings that are words whatever surrounds them."""

    def __init__(self, special: list[str]):
        self.special, self.codes = special, {}

    @property
    def spelled(self) -> list[bytes]:
        """The words by code, in UTF-8."""
        return list(self.codes)

    @property
    def words(self) -> list[str]:
        """The words by code."""
        return [w.decode("utf-8", "surrogatepass") for w in self.codes]

    def _pieces(self, text: str) -> list[tuple[str, bool]]:
        out = [(text, False)]
        for s in self.special:
            if s in text:
                cut = []
                for t, done in out:
                    if done or s not in t:
                        cut.append((t, done))
                        continue
                    for i, x in enumerate(t.split(s)):
                        cut += [(s, True)] * bool(i) + [(x, False)] * bool(x)
                out = cut
        return out

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all words in order, words a text)."""
        pieces = [(k, p, done) for k, t in enumerate(texts) for p, done in (self._pieces(t) if t else ())]
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        whole = "\0".join(p for _, p, _ in pieces) + "\0"
        raw = whole.encode("utf-8", "surrogatepass")
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = classes(cp)
        ends = np.cumsum([len(p) + 1 for _, p, _ in pieces]) - 1
        cls[ends] = END
        start = word_starts(cp, cls)
        for (_, p, done), end in zip(pieces, ends):
            if done:
                start[end - len(p) : end] = False
                start[end - len(p)] = True
        at = np.flatnonzero(start)
        owner = np.searchsorted(ends, at)
        stop = np.minimum(np.concatenate([at[1:], [len(cp)]]), ends[owner])
        byte = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), dtype=np.int64)])
        kinds = np.array([k for k, _, _ in pieces])
        return self.code(raw, byte[at], byte[stop]), np.bincount(kinds[owner], minlength=len(texts))

    def code(self, raw: bytes, start: np.ndarray, stop: np.ndarray, hashed=span_hashes) -> np.ndarray:
        """Codes of the words raw[start:stop]. Hashes only group them: spellings are compared, and words are told apart by spelling where a hash isn't enough."""
        known = self.codes
        _, first, back = np.unique(hashed(raw, start, stop), return_index=True, return_inverse=True)
        if not same_spans(raw, start, stop, first[back]):
            return np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), stop.tolist())), np.int32, len(start))
        codes = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(start[first].tolist(), stop[first].tolist())), np.int32, len(first))
        return codes[back]


def _chunk_rows(ids: list, codes: list[np.ndarray], sizes: list[np.ndarray], words: list[bytes], parts: int, place: tuple[int, int], documents: bool) -> pd.DataFrame:
    """The documents of a chunk as codes of its words, or its words by part. A chunk is named after its place and its content."""
    codes = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    n = np.bincount(codes, minlength=len(words))
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    spelled = [words[i] for i in order.tolist()]
    name = hashlib.blake2b(b"\0".join(spelled) + np.sort(n).tobytes(), digest_size=8, key=repr((place, ids)).encode()[:64])
    chunk = int.from_bytes(name.digest(), "little") >> 2
    if documents:
        known = np.array([0 if i is None else int(i) for i in ids], np.int64)
        blob = pack(known & 0xFFFFFFFF, (known >> 32) & 0xFFFFFFFF, np.array([i is None for i in ids], np.int64), np.concatenate(sizes), rank[codes])
        return pd.DataFrame({"chunk": [chunk], "part": [-1], "blob": [blob]})
    stops = np.cumsum([len(w) for w in spelled])
    where = (span_hashes(b"".join(spelled), np.concatenate([[0], stops[:-1]]), stops, 3) % np.uint64(parts)).astype(np.int64) if spelled else np.zeros(0, np.int64)
    rows = []
    for p in np.unique(where):
        at = np.flatnonzero(where == p)
        own = [spelled[i] for i in at]
        rows.append((chunk, int(p), pack(np.diff(at, prepend=0), np.array([len(w) for w in own], np.int64), b"".join(own))))
    return pd.DataFrame(rows, columns=["chunk", "part", "blob"])


CHUNKS = "chunk long, part int, blob binary"


def _split(special: list[str], parts: int, documents: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seq = TaskContext.get().partitionId(), 0

        def clear():
            return [], [], [], Splitter(special), 0

        ids, codes, sizes, splitter, chars = clear()
        for pdf in batches:
            texts: list[str] = []
            size = 0
            rows = [(None if null else i, t) for i, null, t in zip(pdf["doc_id"].tolist(), pdf["__null"].tolist(), pdf["text"])]
            for k, (i, t) in enumerate(rows):
                ids.append(i)
                texts.append(t or "")
                size += len(t or "")
                if size >= BATCH_CHARS or k == len(rows) - 1:
                    c, n = splitter.split(texts)
                    codes.append(c)
                    sizes.append(n)
                    chars, texts, size = chars + size, [], 0
                    if chars >= CHUNK_CHARS:
                        yield _chunk_rows(ids, codes, sizes, splitter.spelled, parts, (task, seq), documents)
                        seq += 1
                        ids, codes, sizes, splitter, chars = clear()
        if ids:
            yield _chunk_rows(ids, codes, sizes, splitter.spelled, parts, (task, seq), documents)
        ids, codes, sizes, splitter, chars = clear()
        give_back()

    return run


def _encode(path: str):
    """Rows sorted by range: the words that chunks asked for. Each distinct word of a range is encoded once, and a range is forgotten when the next begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        at, known, flat, ends = None, {}, array("I"), array("Q", [0])
        for pdf in batches:
            out = []
            for chunk, part, blob in zip(pdf["chunk"], pdf["part"], pdf["blob"]):
                if part != at:
                    at, known, flat, ends = part, {}, array("I"), array("Q", [0])
                steps, lens, raw = unpack(blob)
                stops = np.cumsum(lens).tolist()
                words = [raw[e - n : e] for e, n in zip(stops, lens.tolist())]
                fresh = [w for w in words if w not in known]  # the words of a chunk are distinct
                for i in range(0, len(fresh), 4096):
                    some = fresh[i : i + 4096]
                    for w, e in zip(some, tok.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False)):
                        known[w] = len(known)
                        flat.extend(e.ids)
                        ends.append(len(flat))
                number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                upto, all_ids = np.frombuffer(ends, np.uint64).astype(np.int64), np.frombuffer(flat, np.uint32)
                start, n = upto[number], upto[number + 1] - upto[number]
                where = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                out.append((chunk, part, pack(steps, n, all_ids[where])))
                del upto, all_ids  # else the arrays can't grow
            yield pd.DataFrame(out, columns=["chunk", "part", "blob"])
        del at, known, flat, ends, tok
        give_back()

    return run


def pieces(path: str = TOKENIZER) -> list[bytes]:
    """The bytes of every id of the vocabulary: a table of fixed size."""
    spec = json.load(open(path, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocab = dict(spec["model"]["vocab"])
    out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
    for w, i in vocab.items():
        out[i] = bytes(back[c] for c in w) if all(c in back for c in w) else w.encode()
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def special_words(path: str = TOKENIZER) -> list[str]:
    return [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]


def _join_back(path: str, whole: bool):
    """Rows sorted by (chunk, part): a chunk's codes, then the ids of its words; yields its documents."""

    def documents(blob: bytes, answers: list[bytes], table: list[bytes]) -> pd.DataFrame:
        low, high, null, sizes, codes = unpack(blob)
        ids = low | (high << 32)
        got = [unpack(a) for a in answers]
        code = np.concatenate([np.cumsum(g[0]) for g in got] or [np.zeros(0, np.int64)])
        lens = np.concatenate([g[1] for g in got] or [np.zeros(0, np.int64)])
        flat = np.concatenate([g[2] for g in got] or [np.zeros(0, np.int64)]).astype("<u4")
        starts = np.cumsum(lens) - lens
        n_codes = len(code)
        if not np.array_equal(np.sort(code), np.arange(n_codes)):
            raise ValueError("the ids of some words of a chunk are missing")
        start_of, len_of = np.zeros(n_codes, np.int64), np.zeros(n_codes, np.int64)
        start_of[code], len_of[code] = starts, lens
        listed = flat.tolist()
        spelled = [b"".join([table[x] for x in listed[s : s + n]]) for s, n in zip(start_of.tolist(), len_of.tolist())]
        rows, at = [], 0
        for i, nul, n in zip(ids.tolist(), null.tolist(), sizes.tolist()):
            own = codes[at : at + n]
            at += n
            m = len_of[own]
            total = int(m.sum())
            where = np.repeat(start_of[own] - (np.cumsum(m) - m), m) + np.arange(total)
            tokens = flat[where]
            text = b"".join(map(spelled.__getitem__, own.tolist())).decode("utf-8", "replace").encode()
            row = (None if nul else i, total, hashlib.sha256(tokens.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
            rows.append(row + ((tokens.tolist(), text.decode()) if whole else ()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if whole else 4])
        out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pieces(path)
        at, blob, answers = None, b"", []
        for pdf in batches:
            for chunk, part, b in zip(pdf["chunk"], pdf["part"], pdf["blob"]):
                if part < 0:
                    if at is not None:
                        yield documents(blob, answers, table)
                    at, blob, answers = chunk, b, []
                elif chunk != at:
                    raise ValueError("the documents of a chunk are missing")
                else:
                    answers.append(b)
        if at is not None:
            yield documents(blob, answers, table)
        del blob, answers, table
        give_back()

    return run


def encode_decode(docs: DataFrame, path: str = TOKENIZER, whole: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text); with whole, also ids and the decoded text.

    Ids are those of the tokenizers library for the file at `path` (a byte-level BPE with the usual pre-tokenizer) without adding special tokens; special
    tokens that a text spells out are found in it. Null and empty texts have no tokens. Repeated rows give a row each. The memory of a task is bounded
    by CHUNK_CHARS and the longest text. Texts are split twice, once for the words and once for the codes, rather than written in between: docs must give the
    same rows in the same order when it is read again, as files do; otherwise the join fails instead of mixing chunks up.
    """
    splits = max(partitions(docs), 8)
    ranges = min(RANGES_A_SPLIT * splits, MAX_RANGES)
    plain = flagged(docs)
    words, coded = (plain.mapInPandas(_split(special_words(path), ranges, documents), CHUNKS) for documents in (False, True))
    answered = words.repartition(min(splits, ranges), "part").sortWithinPartitions("part").mapInPandas(_encode(path), CHUNKS)
    rows = coded.unionByName(answered).repartition(splits, "chunk").sortWithinPartitions("chunk", "part")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if whole else "")
    return rows.mapInPandas(_join_back(path, whole), schema)


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"))
