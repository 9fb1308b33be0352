"""Byte-level BPE by speculation and verification.

Texts are cut into words by the byte-level pattern, evaluated on arrays of
character classes (a text that holds an added token is cut at it first, by a
regular expression). Words not seen before are proposed as the longest matches of the vocabulary from
left to right. A proposal is the BPE encoding exactly if every adjacent pair of
its tokens is compatible, i.e. if the two tokens side by side would not have
merged across their border; all distinct pairs of a batch are tested at once on
arrays of split and merge tables. Only words with an incompatible pair are merged
exactly, with a heap. A word seen before is found by its hash and then compared byte by
byte, so words of one hash do not get each other's tokens.

Null texts are empty and give no tokens. Decoding joins token bytes and replaces
what is no UTF-8.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.textblocks import U64, pieces, release, same_spans, span_hashes, text_buffer
from strandloom.runtime import ship_package

WORD = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NONE = np.int64(1) << 60
# The code points of property White_Space.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    if not _classes:
        table = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        table[list(_WHITE)] = _SPACE
        _classes.append(table)
    return _classes[0]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each word of the byte-level pattern, first word of each text)."""
    code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    n = len(code)
    place = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=place[1:])
    kind = char_classes()[code]
    head = np.zeros(n + 1, dtype=bool)
    head[np.searchsorted(place, off)] = True
    before = np.full(n, 9, dtype=np.uint8)
    before[1:] = kind[:-1]
    before[head[:n]] = 9
    after = np.full(n, 9, dtype=np.uint8)
    after[:-1] = kind[1:]
    after[head[1:]] = 9
    blank = np.zeros(n, dtype=bool)
    blank[1:] = code[:-1] == 0x20
    blank[head[:n]] = False
    space = kind == _SPACE
    start = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != 9)), (kind != before) & ~blank)
    quote = np.flatnonzero(start & (code == 0x27))
    if len(quote):
        text = np.append(code, [0, 0]).astype(np.uint32)
        same1, same2 = ~head[np.minimum(quote + 1, n)], ~head[np.minimum(quote + 2, n)]
        one, two = text[quote + 1], text[quote + 2]
        single = same1 & np.isin(one, [ord(c) for c in "stmd"])
        double = same1 & same2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[single | double] + 1] = False
        rest = np.concatenate([quote[single] + 2, quote[double] + 3])
        rest = rest[rest < n]
        rest = rest[(kind[rest] == _LETTER) & ~head[rest]]
        start[rest] = True
    at = place[np.flatnonzero(start)]
    return at, np.searchsorted(at, off)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one vocabulary. Tokens are numbered by merge rank inside, by vocabulary id outside."""

    def __init__(self, raw: bytes, max_words: int = 1_000_000):
        spec = json.loads(raw)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.max_words = max_words
        self.forget()
        tokens = [bytes((b,)) for b in range(256)]
        rank_of = {t: i for i, t in enumerate(tokens)}
        left, right = list(range(256)), list(range(256))
        self.merge: dict[tuple[int, int], int] = {}
        for m in spec["model"]["merges"]:
            a, b = (as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            if a + b not in rank_of:
                rank_of[a + b] = len(tokens)
                tokens.append(a + b)
                left.append(rank_of[a])
                right.append(rank_of[b])
            self.merge.setdefault((rank_of[a], rank_of[b]), rank_of[a + b])
        ids = {as_bytes(t): i for t, i in vocab.items() if all(c in letters for c in t)}
        self.tokens = tokens
        self.id_of_rank = np.array([ids.get(t, -1) for t in tokens], dtype=np.int64)
        self.left, self.right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        keys = np.array([a * len(tokens) + b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(self.merge.values()), dtype=np.int64)[order]
        own = self.compatible(self.left[256:], self.right[256:], np.arange(256, len(tokens)))
        usable = np.concatenate([np.ones(256, dtype=bool), own])
        usable &= self.id_of_rank >= 0
        step: dict[int, int] = {}  # (node, byte) of a trie over the usable tokens
        ends = [-1]
        for r in np.flatnonzero(usable):
            node = 0
            for x in tokens[r]:
                node = step.setdefault(node << 8 | x, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = int(r)
        arcs = np.array(list(step.items()), dtype=np.int64)
        arcs = arcs[np.argsort(arcs[:, 0])]
        self.arc_keys, self.arc_nodes = np.ascontiguousarray(arcs[:, 0]), np.ascontiguousarray(arcs[:, 1])
        self.node_token = np.array(ends, dtype=np.int64)
        self.added = {}
        for a in spec.get("added_tokens") or []:
            if a.get("single_word") or a.get("lstrip") or a.get("rstrip"):
                raise ValueError(f"added token {a['content']!r} uses options that are not supported")
            self.added[a["content"]] = a["id"]
        by_length = sorted(self.added, key=len, reverse=True)
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.pattern = regex.compile(WORD)
        of_id = {int(i): t for i, t in zip(self.id_of_rank, tokens) if i >= 0} | {i: c.encode() for c, i in self.added.items()}
        parts = [of_id.get(i, b"") for i in range(max(of_id) + 1)]
        self.size_of_id = np.fromiter(map(len, parts), np.int64, len(parts))
        self.place_of_id = np.cumsum(self.size_of_id) - self.size_of_id
        self.all_bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def forget(self) -> None:
        """Empty the table of known words: sorted hashes, where each word's ids lie, and where its bytes lie."""
        self.known = [np.zeros(0, dtype=U64)] * 2
        self.place = [np.zeros((0, 4), dtype=np.int64)] * 2
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.letters = np.zeros(1 << 16, dtype=np.uint8)
        self.n_ids = self.n_letters = 0

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.tokens) + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b stay apart side by side (with ``below``: under merges of lower rank only).

        The latest merge of either token is undone step by step. Had a merge
        across the border been open before that one was made, the pair fails.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NONE) if below is None else below.astype(np.int64)
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self._merged(x, y) < limit[live]
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            whole_x, whole_y = self.right[x] == x, self.left[y] == y
            split_x = ~whole_x & ((x > y) | whole_y)
            split_y = ~split_x & ~whole_y
            limit[live[split_x]] = x[split_x]
            a[live[split_x]] = self.right[x[split_x]]
            limit[live[split_y]] = y[split_y] + 1
            b[live[split_y]] = self.left[y[split_y]]
            live = live[split_x | split_y]
        return ok

    def exact(self, word: bytes) -> list[int]:
        """Merges in rank order, leftmost first, on a linked list with a heap."""
        n = len(word)
        token, nxt, prv = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, token[i], token[i + 1]) for i in range(n - 1) if (m := self.merge.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i] if token[i] == a else n
            if j >= n or token[j] != b:
                continue
            token[i], token[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (k := self.merge.get((m, token[nxt[i]]))) is not None:
                    heapq.heappush(heap, (k, i, m, token[nxt[i]]))
            if prv[i] >= 0 and (k := self.merge.get((token[prv[i]], m))) is not None:
                heapq.heappush(heap, (k, prv[i], token[prv[i]], m))
        return [t for t in token if t >= 0]

    def propose_all(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from left to right: (tokens of all words, number of each)."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        owner, token, where = [], [], []
        live, at = np.arange(len(raw)), begin.copy()
        stop = begin + size
        while len(live):
            node, i = np.zeros(len(live), dtype=np.int64), at[live]
            found, to = buf[i], i + 1
            walk = np.arange(len(live))
            while len(walk):
                key = node[walk] << 8 | buf[i[walk]]
                k = np.searchsorted(self.arc_keys, key)
                k[k == len(self.arc_keys)] = 0
                hit = self.arc_keys[k] == key
                walk, nodes = walk[hit], self.arc_nodes[k[hit]]
                node[walk] = nodes
                i[walk] += 1
                done = self.node_token[nodes] >= 0
                found[walk[done]], to[walk[done]] = self.node_token[nodes[done]], i[walk[done]]
                walk = walk[i[walk] < stop[live[walk]]]
            owner.append(live)
            token.append(found)
            where.append(at[live].copy())
            at[live] = to
            live = live[to < stop[live]]
        order = np.argsort(np.concatenate(where), kind="stable")
        owners = np.concatenate(owner)[order]
        return np.concatenate(token)[order], np.bincount(owners, minlength=len(raw))

    def exact_all(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``exact`` of many words at once: in each round every unfinished word makes its first merge of lowest rank."""
        count = np.fromiter(map(len, raw), np.int64, len(raw))
        token = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(raw)), count)
        done_token, done_word = [], []
        rank = np.full(len(token), _NONE)
        rank[:-1] = self._merged(token[:-1], token[1:])
        rank[np.flatnonzero(np.diff(word, append=-1))] = _NONE
        while len(token):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(first, append=len(token))
            open_ = np.repeat(least < _NONE, sizes)
            done_token.append(token[~open_])
            done_word.append(word[~open_])
            best = np.repeat(least, sizes)[open_]
            token, word, rank = token[open_], word[open_], rank[open_]
            if not len(token):
                break
            hits = np.flatnonzero(rank == best)
            hits = hits[np.diff(word[hits], prepend=-1) != 0]
            token[hits] = rank[hits]
            stay = np.ones(len(token), dtype=bool)
            stay[hits + 1] = False
            place = np.cumsum(stay) - 1
            ends_word = np.append(word[1:] != word[:-1], True)[hits + 1]
            token, word, rank = token[stay], word[stay], rank[stay]
            mine = place[hits]
            rank[mine] = _NONE
            go = mine[~ends_word]
            rank[go] = self._merged(token[go], token[go + 1])
            prev = mine[(mine > 0)]
            prev = prev[word[prev - 1] == word[prev]]
            rank[prev - 1] = self._merged(token[prev - 1], token[prev])
        words = np.concatenate(done_word)
        order = np.argsort(words, kind="stable")
        return np.concatenate(done_token)[order], np.bincount(words, minlength=len(raw))

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        short = [w for w in raw if len(w) <= 64]
        flat, sizes = self._encode_short(short) if short else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        if len(short) < len(raw):
            parts, at, k = [], 0, 0
            for w in raw:
                if len(w) <= 64:
                    parts.append(flat[at : at + sizes[k]])
                    at, k = at + sizes[k], k + 1
                else:
                    p = self.propose_all([w])[0]
                    parts.append(p if self.compatible(p[:-1], p[1:]).all() else np.array(self.exact(w), dtype=np.int64))
            flat, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return self.id_of_rank[flat].astype(np.uint32), sizes

    def _encode_short(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = self.propose_all(raw)
        word_of = np.repeat(np.arange(len(raw)), sizes)
        inside = np.flatnonzero(word_of[1:] == word_of[:-1])
        pairs, where = np.unique(flat[inside] * len(self.tokens) + flat[inside + 1], return_inverse=True)
        fine = self.compatible(pairs // len(self.tokens), pairs % len(self.tokens))
        failing = np.unique(word_of[inside[~fine[where]]])
        if not len(failing):
            return flat, sizes
        merged, lengths = self.exact_all([raw[i] for i in failing.tolist()])
        bad = np.zeros(len(raw), dtype=bool)
        bad[failing] = True
        tokens = np.concatenate([flat[~bad[word_of]], merged])
        owner = np.concatenate([word_of[~bad[word_of]], np.repeat(failing, lengths)])
        sizes[failing] = lengths
        return tokens[np.argsort(owner, kind="stable")], sizes

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """(place, number of ids, place and number of bytes) of each hash, -1 where it is new."""
        out = np.full((len(hashes), 4), -1, dtype=np.int64)
        for known, place in zip(self.known, self.place):
            if len(known):
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes
                out[hit] = place[at[hit]]
        return out

    def _add(self, hashes: np.ndarray, raw: list[bytes]) -> np.ndarray:
        ids, sizes = self.encode_words(raw)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        data, lengths = np.frombuffer(b"".join(raw), dtype=np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        while self.n_letters + len(data) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[self.n_letters : self.n_letters + len(data)] = data
        place = np.stack([self.n_ids + np.cumsum(sizes) - sizes, sizes, self.n_letters + np.cumsum(lengths) - lengths, lengths], axis=1)
        self.n_ids, self.n_letters = self.n_ids + len(ids), self.n_letters + len(data)
        to = 0 if len(self.known[1]) > 100_000 else 1  # a small recent table; the large one is sorted anew now and then
        old = range(2) if to == 0 else (1,)
        both, where = np.concatenate([*(self.known[k] for k in old), hashes]), np.concatenate([*(self.place[k] for k in old), place])
        order = np.argsort(both)
        if to == 0:
            self.known[1], self.place[1] = hashes[:0], place[:0]
        self.known[to], self.place[to] = both[order], where[order]
        return place

    def encode_buffer(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text); an added token counts as ordinary text here."""
        if len(self.known[0]) + len(self.known[1]) > self.max_words:
            self.forget()
        at, first = word_spans(buf, off)
        ends = np.append(at[1:], len(buf))
        unique, example, which = np.unique(span_hashes(buf, at, ends), return_index=True, return_inverse=True)
        found = self._find(unique)
        new = np.flatnonzero(found[:, 0] < 0)
        if len(new):
            data = buf.tobytes()
            spans = zip(at[example[new]].tolist(), ends[example[new]].tolist())
            found[new] = self._add(unique[new], [data[a:b] for a, b in spans])
        word = found[which]
        sizes, where = word[:, 1], word[:, 0]
        other = np.flatnonzero(~same_spans(buf, at, ends, self.letters[: self.n_letters], word[:, 2], word[:, 2] + word[:, 3]))
        ids = self.ids
        if len(other):  # another word of the same hash is known: these are encoded on their own
            data = buf.tobytes()
            own, lengths = self.encode_words([data[a:b] for a, b in zip(at[other].tolist(), ends[other].tolist())])
            where, sizes = where.copy(), sizes.copy()
            where[other], sizes[other] = self.n_ids + np.cumsum(lengths) - lengths, lengths
            ids = np.concatenate([ids[: self.n_ids], own])
        total = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=total[1:])
        take = np.arange(total[-1]) + np.repeat(where - total[:-1], sizes)
        return ids[take], total[first]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        column = pa.array(texts, pa.large_string())
        ids, first = self.encode_buffer(*text_buffer(column))
        out = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        for i, text in enumerate(texts):
            if any(c in text for c in self.added):
                out[i] = self._with_added(text)
        return out

    def _with_added(self, text: str) -> np.ndarray:
        parts = [np.zeros(0, dtype=np.uint32)]
        for k, x in enumerate(self.added_pattern.split(text)):
            if k % 2:
                parts.append(np.array([self.added[x]], dtype=np.uint32))
            elif x:
                parts.append(self.encode_words([w.encode() for w in self.pattern.findall(x)])[0])
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.size_of_id[ids]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.place_of_id[ids] - (ends - sizes), sizes)
        return self.all_bytes[take].tobytes().decode("utf-8", "replace")


_loaded: dict[bytes, Bpe] = {}


def _bpe(raw: bytes) -> Bpe:
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(raw)
    return _loaded[key]


def encode_texts(docs: DataFrame, vocabulary: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """key, the token ids of each whole text, and digests of the ids and of the text decoded from them.

    ``vocabulary`` is the path of a tokenizers JSON file on the driver. It is read
    there and broadcast; a vocabulary does not grow with the data.
    One row for each row of ``docs``, whatever its key, repeated rows included; no rows give no rows. A null text is
    empty and has no tokens. Only ``key`` and ``text`` are read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).alias("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                coded = bpe.encode_batch([x or "" for x in part.column(1).to_pylist()])
                out = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(x) for x in coded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in coded], pa.string()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32()))
                yield pa.record_batch(out)
        bpe.forget()
        release()

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
