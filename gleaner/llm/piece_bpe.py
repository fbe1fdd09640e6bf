"""SentencePiece BPE encoding by a table of last tokens, and decoding.

For every prefix of a word there is exactly one token with which its encoding
ends.  An automaton over the vocabulary gives the tokens that end at a position;
the one that is *compatible* with the last token of the prefix before it (the
two, joined, encode as just these two) is stored.  Ids are then recovered from
the end backwards.  The table is linear in the text, whatever its length.

Merging is decided by the joined string alone (any two neighbours whose joined
string is a piece may merge, best score first), which is what makes the test on
pairs sufficient as long as scores differ.  Words with runs of spaces, whose
pieces share one score, or with characters that only occur inside longer pieces
are merged directly instead.  Many short words are looked at together by numpy;
for a long word the same automaton is walked character by character.

Cases: a null or empty text has only the begin and end ids and decodes to "";
characters outside the vocabulary become byte pieces; very long texts are
encoded whole, in sections that end between words, so that memory grows with
the ids and the longest word; repeated rows, empty tables and other columns are
as for any projection.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from .arrow import per_text
from .bpe import NEVER, merge, merge_until
from .tables import Table64, WordMemory, code_points, cut_text, document_sums, groups_by_size

SPACE = "\u2581"
#: Words up to this size are looked at many at a time.
SHORT = 64
#: Ids that are decoded at a time.
DECODED = 1 << 18
#: Remembered pairs of tokens.
PAIRS = 1_000_000


def _one_byte(error: UnicodeDecodeError):
    return "\ufffd", error.start + 1


codecs.register_error("gleaner_one_byte", _one_byte)


def _as_dict(table: Table64) -> dict[int, int]:
    """A table whose keys were put in with 2 added."""
    used = np.flatnonzero(table.keys)
    return dict(zip((table.keys[used] - np.uint64(2)).tolist(), table.values[used].tolist(), strict=True))


class PieceBpe:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" \u2047 ".encode())
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.pieces[piece] = i
                    self.score[piece] = -sp.get_score(i)
        self.is_byte = np.zeros(len(self.surface), bool)
        self.is_byte[self.byte_ids] = True
        inner = {c for p in self.pieces for c in p}
        self.spaced = {i for p, i in self.pieces.items() if p[0] == SPACE}
        self.direct_only = inner - self.pieces.keys()
        if "\n" in inner or any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces that hold a line end or a space after another character are not handled")
        self.inside = re.compile("([^" + re.escape("".join(sorted(inner))) + "])")
        self.strange = re.compile("[^" + re.escape("".join(sorted(inner - self.direct_only))) + "]").search
        self._index()
        self.memory = WordMemory(self.words_ids, "<u4", 300_000)

    def _index(self) -> None:
        """Tokens by rank (single characters first, then in the order of merging), their trie, last merges and pairs that merge."""
        tokens = sorted(self.pieces, key=lambda p: (len(p) > 1, self.score[p]))
        number = {p: t for t, p in enumerate(tokens)}
        self.ids = np.array([self.pieces[p] for p in tokens], np.uint32)
        self.sizes = np.array([len(p) for p in tokens], np.int64)
        self.longest = int(self.sizes.max())
        self.left = np.arange(len(tokens))
        self.right = np.arange(len(tokens))
        nodes: dict[tuple[int, int], int] = {}
        accept = [-1]
        pairs: dict[int, int] = {}
        for t, p in enumerate(tokens):
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = t
            if p.count(SPACE) > 1:
                continue
            last = merge_until(list(p), self.rank, 2)
            if len(p) > 1 and (len(last) != 2 or last[0] + last[1] != p or last[0] not in number or last[1] not in number or merge(list(p), self.rank) != [p]):
                continue  # its own text encodes otherwise, so it never occurs
            if len(p) > 1:
                self.left[t], self.right[t] = number[last[0]], number[last[1]]
            node = 0
            for c in p:
                node = nodes.setdefault((node, ord(c)), len(accept))
                if node == len(accept):
                    accept.append(-1)
            accept[node] = t
        self.accept = np.array(accept)
        self.edges = Table64(2 * len(nodes))
        self.edges.put(np.array([(a << 21 | c) + 2 for a, c in nodes], np.uint64), np.fromiter(nodes.values(), np.int64))
        self.pairs = Table64(2 * len(pairs))
        self.pairs.put(np.array(list(pairs), np.uint64) + np.uint64(2), np.fromiter(pairs.values(), np.int64))
        self.fits = Table64(1 << 16)
        self.walk_fits: dict[int, bool] = {}

    # The same tables for one look-up at a time, made when a long word first needs them.
    @functools.cached_property
    def walk(self) -> dict[int, int]:
        return _as_dict(self.edges)

    @functools.cached_property
    def walk_pairs(self) -> dict[int, int]:
        return _as_dict(self.pairs)

    @functools.cached_property
    def plain(self) -> list[list[int]]:
        return [x.tolist() for x in (self.accept, self.ids, self.sizes, self.left, self.right)]

    def rank(self, a: str, b: str) -> float:
        return self.score.get(a + b, NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether their joined string encodes as just these two.

        Merges are undone, the latest first; the pair fails if two tokens that
        meet at the border would have merged before.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 40)
        left = np.arange(len(a))
        while len(left):
            x, y = a[left], b[left]
            joined = self.pairs.get((x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)) + np.uint64(2))
            bad = (joined >= 0) & (joined < limit[left])
            good[left[bad]] = False
            first = x > y
            limit[left] = np.where(first, x, y + 1)
            a[left] = np.where(first, self.right[x], x)
            b[left] = np.where(first, y, self.left[y])
            left = left[~bad & (self.sizes[np.maximum(x, y)] > 1)]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same, remembered."""
        keys = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(2)
        found = self.fits.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            fit = self._compatible(a[new[first]], b[new[first]]).astype(np.int64)
            if self.fits.used > PAIRS:
                self.fits.reset(1 << 16)
            self.fits.put(distinct, fit)
            found[new] = fit[back]
        return found == 1

    def last_tokens(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each prefix of each word (rows of code points), the token with which its encoding ends; -1 for the empty prefix."""
        n, width = codes.shape
        last = np.full((n, width + 1), -1, np.int64)
        for j in range(width):
            rows = np.flatnonzero(sizes > j)
            before, node = last[rows, j], np.zeros(len(rows), np.int64)
            for size in range(1, min(self.longest, width - j) + 1):
                here = sizes[rows] >= j + size
                rows, before, node = rows[here], before[here], node[here]
                node = self.edges.get(((node << 21) + codes[rows, j + size - 1]).astype(np.uint64) + np.uint64(2))
                here = node >= 0
                rows, before, node = rows[here], before[here], node[here]
                if not len(rows):
                    break
                token = self.accept[node]
                match = np.flatnonzero(token >= 0)
                if j and len(match):
                    match = match[self.compatible(before[match], token[match])]
                last[rows[match], j + size] = token[match]
        return last

    def _table_ids(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of known characters with one space at most, recovered backwards from the table."""
        out: list[np.ndarray] = []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            width = max(map(len, part))
            codes = np.array(part, dtype=f"U{width}").view(np.uint32).reshape(len(part), width).astype(np.int64)
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            last = self.last_tokens(codes, sizes)
            ids, at = np.zeros((len(part), width), np.uint32), sizes.copy()
            count, rows = np.zeros(len(part), np.int64), np.arange(len(part))
            while len(rows):
                token = last[rows, at[rows]]
                count[rows] += 1
                ids[rows, width - count[rows]] = self.ids[token]
                at[rows] -= self.sizes[token]
                rows = rows[at[rows] > 0]
            out += [ids[r, width - c :] for r, c in enumerate(count.tolist())]
        return out

    def _fits(self, a: int, b: int) -> bool:
        """:meth:`_compatible` for one pair."""
        sizes, lefts, rights = self.plain[2:]
        limit = 1 << 40
        while True:
            joined = self.walk_pairs.get(a << 32 | b)
            if joined is not None and joined < limit:
                return False
            if sizes[max(a, b)] <= 1:
                return True
            if a > b:
                limit, a = a, rights[a]
            else:
                limit, b = b + 1, lefts[b]

    def _long_ids(self, word: str) -> list[int]:
        """The same table for one word, filled by walking the automaton from every character, and read backwards."""
        accept, ids, sizes = self.plain[:3]
        walk, fits = self.walk, self.walk_fits
        codes = array("I", code_points(word).tobytes())
        n, longest = len(codes), self.longest
        last = array("i", [-1]) * (n + 1)
        for j in range(n):
            before, node = last[j], 0
            for p in range(j, min(j + longest, n)):
                node = walk.get(node << 21 | codes[p])
                if node is None:
                    break
                token = accept[node]
                if token < 0:
                    continue
                if j:
                    pair = before << 32 | token
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) > PAIRS:
                            fits.clear()
                        fit = fits[pair] = self._fits(before, token)
                    if not fit:
                        continue
                last[p + 1] = token
        out = []
        while n:
            out.append(ids[last[n]])
            n -= sizes[last[n]]
        return out[::-1]

    def tokens(self, word: str) -> list[str]:
        """Pieces of a word by direct merging."""
        return merge(list(word), self.rank)

    def word_ids(self, word: str) -> np.ndarray:
        """Ids of a word with characters outside the vocabulary, several spaces, or great length."""
        ids: list[int] = []
        for k, part in enumerate(self.inside.split(word)):
            if k % 2:
                ids += [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
            elif part and SPACE * 2 not in part and not self.strange(part):
                ids += self._long_ids(part)
            elif part:
                for token in self.tokens(part):
                    i = self.pieces.get(token)
                    ids += [i] if i is not None else [self.byte_ids[b] for b in token.encode()]
        return np.array(ids, np.uint32)

    def words_ids(self, words: list[str]) -> list[np.ndarray]:
        """Ids of many words."""
        plain, out = [], [None] * len(words)
        for k, w in enumerate(words):
            if len(w) <= SHORT and SPACE * 2 not in w and not self.strange(w):
                plain.append(k)
            else:
                out[k] = self.word_ids(w)
        for k, ids in zip(plain, self._table_ids([words[k] for k in plain]), strict=True):
            out[k] = ids
        return out

    @staticmethod
    def _borders(codes: np.ndarray) -> np.ndarray:
        """Where words begin: at line ends and at spaces after something else."""
        space = (codes == 32) | (codes == ord(SPACE))
        return np.flatnonzero((codes[1:] == 10) | space[1:] & ~space[:-1]) + 1

    def encode(self, texts: list[str], ends: bool = True) -> list[np.ndarray]:
        """Ids of each text."""
        sections = [cut_text(t, self._borders) for t in texts]
        parts: list[list[np.ndarray]] = [[np.array([self.bos] * ends, np.uint32)] for _ in texts]
        owners = [k for k, cut in enumerate(sections) for _ in cut]
        flat = [SPACE + x if k == 0 and x else x for cut in sections for k, x in enumerate(cut)]
        for a, b in groups_by_size(flat):
            for owner, ids in zip(owners[a:b], self._encode(flat[a:b]), strict=True):
                parts[owner].append(ids)
        end = np.array([self.eos] * ends, np.uint32)
        return [np.concatenate((*p, end)) for p in parts]

    def _encode(self, sections: list[str]) -> list[np.ndarray]:
        """Ids of sections of texts, which begin with a word each."""
        joined = "".join(sections).replace(" ", SPACE)
        codes = code_points(joined)
        bounds = np.cumsum([0, *map(len, sections)])
        if not len(codes):
            return [np.zeros(0, np.uint32) for _ in sections]
        space, line = codes == ord(SPACE), codes == 10
        start = space | line
        start[1:] &= ~(space[1:] & space[:-1])
        start[1:] |= line[:-1]
        start[np.unique(bounds[:-1][np.diff(bounds) > 0])] = True
        starts = np.flatnonzero(start)
        entries = self.memory.entries(joined, codes, starts)
        ids = self.memory.gather(entries)
        cuts = np.concatenate(([0], np.cumsum(document_sums(self.memory.count[entries], np.searchsorted(starts, bounds)))))
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode_parts(self, ids) -> Iterator[str]:
        """The decoded text in parts; none is cut inside a run of byte pieces."""
        ids = np.asarray(ids, np.int64)
        surface, begin, first = self.surface, 0, True
        while begin < len(ids):
            end = min(begin + DECODED, len(ids))
            while end < len(ids) and self.is_byte[ids[end]]:
                end += 1
            own = ids[begin:end].tolist()
            parts = [surface[i] for i in own]
            if first:
                for k, p in enumerate(parts):
                    if p:
                        if own[k] in self.spaced:
                            parts[k] = p[1:]
                        first = False
                        break
            at = 0
            for k in [k for k, p in enumerate(parts) if not p] + [len(parts)]:
                yield b"".join(parts[at:k]).decode("utf-8", "gleaner_one_byte")
                at = k + 1
            begin = end

    def decode(self, ids) -> str:
        """Text of a sequence of ids; the space that encoding puts first is taken off, bytes that are no character become U+FFFD each; a control id ends a run of bytes."""
        return "".join(self.decode_parts(ids))


_LOADED: dict[str, PieceBpe] = {}


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _loaded(path: str, model) -> PieceBpe:
    if path not in _LOADED:
        _LOADED[path] = PieceBpe(model.value)
    return _LOADED[path]


def encode(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys with ids, the whole encoding of each text with begin and end ids."""
    model = df.sparkSession.sparkContext.broadcast(read_model(path))

    def make():
        bpe = _loaded(path, model)
        return lambda texts: [(ids.astype(np.int32),) for ids in bpe.encode(texts)]

    return per_text(df, list(keys), text, "ids array<int>", make)


def encode_and_decode(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys with n_tokens, ids_sha256 and decoded_sha256, the digests of the ids and of the text decoded from them."""
    model = df.sparkSession.sparkContext.broadcast(read_model(path))

    def make():
        bpe = _loaded(path, model)

        def rows(texts: list[str]) -> list[tuple]:
            out = []
            for ids in bpe.encode(texts):
                decoded = hashlib.sha256()
                for part in bpe.decode_parts(ids):
                    decoded.update(part.encode())
                out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), decoded.hexdigest()))
            return out

        return rows

    return per_text(df, list(keys), text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
