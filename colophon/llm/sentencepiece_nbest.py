"""SentencePiece encoding and decoding with n-best segmentation.

The lattice of a text has an arc for each vocabulary piece that stands in it (and one for a character outside the
vocabulary, which becomes its UTF-8 bytes).  A forward Viterbi pass gives the best score up to each position.  A*
then runs backward from the end: what is behind a position is known, what lies before it is estimated by the forward
score, and as that is exact, segmentations come out in order of score and no state is opened in vain.  Following the
best arc back loses nothing, so a state goes on along the best arcs at once, and only the arcs that leave this way
are put into the queue, each with what it loses; every entry stands for a segmentation of its own, so the queue needs
no more entries than segmentations are still wanted.  Time is linear in the text and in n; memory is a few arrays.

No piece contains a word start behind another character, or (nearly) letters beside others, so every segmentation has
a boundary there and the lattice of a text is a chain of word lattices.  Arcs of different words never cross: what an
arc loses is the same in the word's lattice and in the text's, so the search over the text opens the words with the
smallest losses (at most n - 1 of them) and no others.  The forward pass runs over all different words of some texts at
once, position by position, in numpy; equal words are solved once a task (a cache bounded in words and in characters).

Defined results: a null text counts as empty; an empty text has no pieces and one segmentation with score 0; texts
with fewer segmentations than asked for give fewer scores; among equal scores the order is fixed but arbitrary.
Decoding gives back every text exactly, the word mark U+2581 itself included.  A word may be as long as a text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from bisect import insort
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
N_BEST = 4
#: Words, characters of words and n-best lists that a worker keeps at most; words up to a length are solved together.
CACHE, CACHE_CHARS, LISTS, CACHED_CHARS = 250_000, 4 << 20, 5_000, 64
#: Characters of texts whose words are solved together; longer texts are encoded so many words at a time, and ids
#: decoded so many.
LONG_TEXT, AT_ONCE = 1 << 20, 1 << 17
_LOW = -1e300


class Vocabulary:
    """Pieces with scores, read from a SentencePiece model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.pieces[piece] = (i, p.get_score(i))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        #: character -> (id or -1, score, further characters)
        self.trie: dict = {}
        for piece in sorted(self.pieces, key=len):
            node = self.trie
            for c in piece[:-1]:
                if c not in node:
                    node[c] = (-1, 0.0, {})
                node = node[c][2]
            node[piece[-1]] = (*self.pieces[piece], node[piece[-1]][2] if piece[-1] in node else {})
        #: the same from the last character backward
        self.back: dict = {}
        for piece in sorted(self.pieces, key=len):
            node = self.back
            for c in piece[:0:-1]:
                if c not in node:
                    node[c] = (-1, 0.0, {})
                node = node[c][2]
            node[piece[0]] = (*self.pieces[piece], node[piece[0]][2] if piece[0] in node else {})
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - 10.0
        marked = any(MARK in x.lstrip(MARK) for x in self.pieces)
        if marked:
            raise ValueError("pieces cross word starts; texts cannot be cut there")
        self.cut = re.compile(self._word_pattern())
        self._number_nodes()
        self.forget()
        self.lists: dict[str, tuple[int, list]] = {}

    def _word_pattern(self) -> str:
        """Where every segmentation of a text has a boundary: at word marks, and between letters and other characters
        unless some piece has the two together (its letters then count as other characters)."""
        odd: set[str] = set()
        while True:
            letter = re.compile(rf"[^\W\d_{re.escape(''.join(sorted(odd)))}]")
            more = set()
            for piece in self.pieces:
                kinds = [bool(letter.match(c)) for c in piece.lstrip(MARK)]
                if len(set(kinds)) > 1:
                    more |= {c for c in piece if letter.match(c)}
            if not more:
                break
            odd |= more
        other = rf"(?:(?!{letter.pattern})[^{MARK}\n])+"
        alone = "" if any("\n" in x for x in self.pieces if x != "\n") else "\n|"
        if not alone:
            other = other.replace("\\n", "")
        return f"{alone}{MARK}*{letter.pattern}+|{MARK}*{other}|{MARK}+"

    def forward(self, word: str) -> tuple:
        """Up to each position the best and the second best score, and the best way's last arc (start, piece or -1)."""
        n, root = len(word), self.trie
        best, second, start, last = [_LOW], [_LOW], [0], [-1]
        if n > CACHED_CHARS:
            best, second, start, last = array("d", best), array("d", second), array("i", start), array("i", last)
        best, second, start, last = best * (n + 1), second * (n + 1), start * (n + 1), last * (n + 1)
        best[0] = 0.0
        for i in range(n):
            at, next_best, node, j = best[i], second[i], root.get(word[i]), i + 1
            if node is None or node[0] < 0:
                score = at + self.unknown
                if score > best[j]:
                    second[j], best[j], start[j], last[j] = max(best[j], next_best + self.unknown), score, i, -1
                elif score > second[j]:
                    second[j] = score
            while node is not None:
                piece, own, more = node
                if piece >= 0:
                    score = at + own
                    if score > best[j]:
                        other = next_best + own
                        second[j] = best[j] if best[j] > other else other
                        best[j], start[j], last[j] = score, i, piece
                    elif score > second[j]:
                        second[j] = score
                if j == n:
                    break
                node = more.get(word[j])
                j += 1
        return best, second, start, last

    def solve(self, word: str) -> tuple:
        """Ids of the best segmentation of one word, its score, and the loss of the second best (inf: there is none)."""
        if word[0] == "\0":
            return self._odd(word)
        best, second, start, last = self.forward(word)
        n = len(word)
        return self._path(word, None, start, last), best[n], best[n] - second[n] if second[n] > -1e299 else float("inf")

    def _number_nodes(self) -> None:
        """The trie as arrays: (node, character) -> node as sorted keys, and each node's piece (or -1) and score."""
        keys, targets, pieces, scores = [], [], [-1], [0.0]
        open_nodes = [(0, self.trie)]
        while open_nodes:
            node, children = open_nodes.pop()
            for c, (piece, score, more) in children.items():
                keys.append(node << 21 | ord(c))
                targets.append(len(pieces))
                open_nodes.append((len(pieces), more))
                pieces.append(piece)
                scores.append(score)
        order = np.argsort(keys)
        self.edges, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]
        self.node_piece, self.node_score = np.array(pieces, np.int32), np.array(scores)
        self.first_node = np.full(0x110000, -1, np.int32)
        roots = self.edges < 1 << 21
        self.first_node[self.edges[roots]] = self.targets[roots]
        self.byte_ids = np.array(self.byte_id, np.int32)

    def arcs(self, codes: np.ndarray, end: np.ndarray) -> tuple:
        """(start, length, piece or -1, score) of the arcs of all words; ``end``: of each character's word."""
        start = np.arange(len(codes))
        node = self.first_node[codes]
        raw = start[(node < 0) | (self.node_piece[node] < 0)]
        found = [(raw, np.ones(len(raw), np.int64), np.full(len(raw), -1, np.int32), np.full(len(raw), self.unknown))]
        start, length = start[node >= 0], 1
        node = node[start]
        while len(start):
            whole = self.node_piece[node] >= 0
            at = node[whole]
            found.append((start[whole], np.full(len(at), length), self.node_piece[at], self.node_score[at]))
            on = start + length < end[start]
            start, node = start[on], node[on]
            key = node.astype(np.int64) << 21 | codes[start + length]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[place] == key
            start, node, length = start[hit], self.targets[place[hit]], length + 1
        return tuple(np.concatenate(x) for x in zip(*found))

    def solve_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``solve`` for many short words at once: all ids, how many each word has, scores, losses of the second best."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        start, length, piece, score = self.arcs(codes, ends[word])
        # a word of k characters has k + 1 positions, numbered through all words
        origin = ends - size + np.arange(len(words))
        source = start + word[start]
        target = source + length
        depth = target - origin[word[start]]
        # by position in the word, then by word, then earlier starts first: those win among equal scores
        order = np.argsort((depth << 40 | target) << 7 | (CACHED_CHARS - length))
        source, target, piece, score, start, depth = (x[order] for x in (source, target, piece, score, start, depth))
        best, second = np.full(len(codes) + len(words), _LOW), np.full(len(codes) + len(words), _LOW)
        came, own = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        best[origin] = 0.0
        cuts = np.searchsorted(depth, np.arange(1, CACHED_CHARS + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            at = target[a:b]
            new = np.concatenate([[True], at[1:] != at[:-1]])
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            value, other = best[source[a:b]] + score[a:b], second[source[a:b]] + score[a:b]
            most = np.maximum.reduceat(value, first)
            winners = np.flatnonzero(value == most[group])
            winners = winners[np.diff(group[winners], prepend=-1) > 0]
            value[winners] = _LOW
            here = at[first]
            best[here], second[here] = most, np.maximum(np.maximum.reduceat(value, first), np.maximum.reduceat(other, first))
            came[here], own[here] = source[a:b][winners], a + winners
        # back from all ends at once
        at, live, taken = ends + np.arange(len(words)), np.arange(len(words)), []
        last = at
        while len(live):
            taken.append((live, own[at]))
            at = came[at]
            on = at > origin[live]
            at, live = at[on], live[on]
        of, arc = (np.concatenate(x) for x in zip(*taken))
        turn = np.concatenate([np.full(len(x), -i) for i, (x, _) in enumerate(taken)])
        order = np.lexsort((turn, of))
        of, arc = of[order], arc[order]
        ids, counts = self._with_bytes(piece[arc], codes[start[arc]])
        per_word = np.bincount(of, weights=counts, minlength=len(words)).astype(np.int64)
        loss = np.where(second[last] > -1e299, best[last] - second[last], np.inf)
        return ids, per_word, best[last], loss

    def _with_bytes(self, piece: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces, and in place of each -1 the byte pieces of the character; how many ids each became."""
        raw = piece < 0
        count = np.where(raw, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        at = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        ids[at[~raw]] = piece[~raw]
        for n, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            some = raw & (count == n)
            c, place = code[some], at[some]
            for k in range(n):
                part = c >> 6 * (n - 1 - k)
                ids[place + k] = self.byte_ids[mark | part if k == 0 else 0x80 | part & 63]
        return ids, count

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars, self.flat = 0, np.zeros(0, np.int32)
        self.counts, self.firsts, self.scores, self.losses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of the words among those solved; those not known yet are solved together."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if fresh and (len(self.index) + len(fresh) > CACHE or self.chars > CACHE_CHARS):
            self.forget()
            fresh = list(dict.fromkeys(words))
        if fresh:
            short = [w for w in fresh if len(w) <= CACHED_CHARS and w[0] != "\0"]
            others = [w for w in fresh if len(w) > CACHED_CHARS or w[0] == "\0"]
            ids, count, score, loss = self.solve_all(short) if short else (self.flat[:0], self.counts[:0], self.scores[:0], self.losses[:0])
            alone = [self.solve(w) for w in others]
            count = np.append(count, [len(x[0]) for x in alone]).astype(np.int64)
            self.firsts = np.append(self.firsts, len(self.flat) + np.cumsum(count) - count)
            self.flat = np.concatenate([self.flat, ids, *[np.array(x[0], np.int32) for x in alone]])
            self.counts = np.append(self.counts, count)
            self.scores = np.append(self.scores, np.append(score, [x[1] for x in alone]))
            self.losses = np.append(self.losses, np.append(loss, [x[2] for x in alone]))
            self.index.update(zip(chain(short, others), range(len(self.index), len(self.index) + len(fresh))))
            self.chars += sum(map(len, fresh))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _raw(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in character.encode("utf-8", "surrogatepass"))

    def _path(self, word: str, turns: tuple | None, start, last) -> array:
        """Ids of the way that takes the arcs of ``turns`` (position, start, piece, earlier ones) and the best ones else."""
        order = []
        while turns:
            order.append(turns)
            turns = turns[3]
        ids, at = array("i"), len(word)
        while at:
            turned = order and order[-1][0] == at
            _, i, piece, _ = order.pop() if turned else (at, start[at], last[at], None)
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(reversed(self._raw(word[i])))
            at = i
        ids.reverse()
        return ids

    def nbest(self, word: str, n: int) -> list[tuple[float, array]]:
        """The n best segmentations (score, ids) of a word lattice, by A* from its end with exact heuristics."""
        asked, ways = self.lists.get(word, (0, []))
        if asked >= n:
            return ways[:n]
        best, _, start, last = self.forward(word)
        queue, ways, made, back = [(0.0, 0, None, len(word))], [], 0, self.back
        while queue:
            loss, _, turns, at = queue.pop(0)
            ways.append((best[-1] - loss, self._path(word, turns, start, last)))
            room = n - len(ways)
            if not room:
                break
            del queue[room:]
            worst = queue[-1][0] if len(queue) == room else float("inf")
            while at:
                behind, first, usual = loss + best[at], start[at], last[at]
                node, i = back.get(word[at - 1]), at - 1
                arcs = [] if node is not None and node[0] >= 0 else [(i, -1, self.unknown)]
                while node is not None:
                    if node[0] >= 0:
                        arcs.append((i, node[0], node[1]))
                    i -= 1
                    node = node[2].get(word[i]) if i >= 0 else None
                for i, piece, score in arcs:
                    more = behind - (best[i] + score)
                    if more < worst and (i != first or piece != usual):
                        made += 1
                        insort(queue, (more, made, (at, i, piece, turns), i))
                        del queue[room:]
                        worst = queue[-1][0] if len(queue) == room else float("inf")
                at = first
        if len(word) <= CACHED_CHARS:
            if len(self.lists) >= LISTS:
                self.lists.clear()
            self.lists[word] = (n, ways)
        return ways

    def blocks(self, text: str):
        """The words of the text, which starts with a word mark, in lists."""
        if not text:
            return
        if MARK in text or "\0" in text:
            words = self._split_odd(text)
        elif len(text) <= LONG_TEXT:
            yield self.cut.findall(MARK + text.replace(" ", MARK))
            return
        else:
            words = (m[0] for m in self.cut.finditer(MARK + text.replace(" ", MARK)))
        while some := list(islice(words, AT_ONCE)):
            yield some

    def _split_odd(self, text: str):
        """Marks and NULs of the text become words of their own (NUL, or two of them), written as bytes."""
        first = True
        for odd in re.finditer(f"[{MARK}\0]|[^{MARK}\0]+", text):
            part = odd[0]
            if part in (MARK, "\0"):
                if first:
                    yield MARK
                yield "\0" if part == MARK else "\0\0"
            else:
                for m in self.cut.finditer((MARK if first else "") + part.replace(" ", MARK)):
                    yield m[0]
            first = False

    def encode(self, text: str, n: int = 1, solved=None) -> tuple[np.ndarray, list[float], list]:
        """Ids of the best segmentation, the n best scores, and for each what it changes: [(word number, place among
        the best ids, how many of them go, ids instead)], by word.  ``solved``: the text's words and their numbers, if known."""
        parts, total, near, words_before, ids_before = [np.zeros(0, np.int32)], 0.0, [], 0, 0
        for words, number in ((w, self.numbers(w)) for w in self.blocks(text)) if solved is None else [solved]:
            count = self.counts[number]
            place = np.cumsum(count) - count
            parts.append(self.flat[np.repeat(self.firsts[number] - place, count) + np.arange(count.sum())])
            total += float(self.scores[number].sum())
            if n > 1:
                loss = self.losses[number]
                some = np.argpartition(loss, n - 2)[: n - 1] if len(loss) > n - 1 else np.arange(len(loss))
                near += [(x, words_before + k, ids_before + int(place[k]), words[k]) for x, k in zip(loss[some].tolist(), some.tolist()) if x < float("inf")]
                near = sorted(near)[: n - 1]
            words_before, ids_before = words_before + len(words), ids_before + len(parts[-1])
        ids = parts[1] if len(parts) == 2 else np.concatenate(parts)
        if not near:
            return ids, [total], [[]]
        choices = [(k, at, self.nbest(word, n)) for _, k, at, word in near]
        losses = [[ways[0][0] - w[0] for w in ways] for _, _, ways in choices]
        start = (0,) * len(choices)
        queue, seen, scores, changes = [(0.0, start)], set(), [], []
        while queue and len(scores) < n:
            loss, picks = heapq.heappop(queue)
            scores.append(total - loss)
            changes.append(sorted((choices[c][0], *_changed(choices[c][1], choices[c][2][0][1], choices[c][2][p][1])) for c, p in enumerate(picks) if p))
            for c in range(len(picks)):
                more = picks[:c] + (picks[c] + 1,) + picks[c + 1 :]
                if more[c] < len(losses[c]) and more not in seen:
                    seen.add(more)
                    heapq.heappush(queue, (sum(losses[x][p] for x, p in enumerate(more)), more))
        return ids, scores, changes

    def encode_all(self, texts: list[str], n: int):
        """``encode`` of each text; the words of as many texts as LONG_TEXT characters take are solved together."""
        at = 0
        while at < len(texts):
            size, some = 0, []
            while at < len(texts) and (not some or size + len(texts[at]) <= LONG_TEXT):
                some.append(texts[at])
                size += len(texts[at])
                at += 1
            if len(some) == 1:
                yield self.encode(some[0], n)
                continue
            words = [list(chain.from_iterable(self.blocks(t))) for t in some]
            ends = np.cumsum([0, *map(len, words)])
            number = self.numbers(list(chain.from_iterable(words)))
            for k, t in enumerate(some):
                yield self.encode(t, n, (words[k], number[ends[k] : ends[k + 1]]))

    def _odd(self, word: str) -> tuple:
        raw = MARK.encode() if word == "\0" else b"\0"
        return tuple(self.byte_id[b] for b in raw), self.unknown, float("inf")

    def decode(self, ids) -> str:
        """The text of the ids: pieces joined, bytes put together, the first word mark dropped."""
        ids = np.asarray(ids, np.int32)
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[a : a + AT_ONCE].tolist())) for a in range(0, len(ids), AT_ONCE)]
        return b"".join(parts).decode("utf-8", "surrogatepass")[1:]


def _changed(at: int, old, new) -> tuple[int, int, array]:
    """Where the ids of two ways differ: place, how many go, what comes instead (what both end with is left out)."""
    least, head, tail = min(len(old), len(new)), 0, 0
    if least > CACHED_CHARS:
        a, b = np.frombuffer(old, np.int32), np.frombuffer(new, np.int32)
        apart = np.flatnonzero(a[:least] != b[:least])
        head = int(apart[0]) if len(apart) else least
        apart = np.flatnonzero(a[::-1][: least - head] != b[::-1][: least - head])
        tail = int(apart[0]) if len(apart) else least - head
    else:
        while head < least and old[head] == new[head]:
            head += 1
        while tail < least - head and old[-1 - tail] == new[-1 - tail]:
            tail += 1
    return at + head, len(old) - head - tail, new[head : len(new) - tail]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _with_vocabulary(spark, path: str):
    """The model's bytes for every executor (a vocabulary file, half a megabyte); built once a worker."""
    shared = spark.sparkContext.broadcast(read_model(path))
    key = hashlib.sha1(shared.value).hexdigest()

    def get() -> Vocabulary:
        if key not in _built:
            _built[key] = Vocabulary(shared.value)
        return _built[key]

    return get


_built: dict[str, Vocabulary] = {}


def encode_documents(docs: DataFrame, path: str = MODEL, n: int = N_BEST, with_ids: bool = True, with_alternatives: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids, ids_sha256, scores (n best, best first), alternatives and round_trip for each document.

    ``ids`` and ``alternatives`` are null if not asked for; ``alternatives`` names, for each further segmentation, the
    words it segments otherwise: ``ids`` stand in place of the ``old`` best ids from the ``at``-th (from 0) on, so that
    every segmentation follows from the row (``segmentations``).  ``round_trip`` says whether decoding the ids of the
    best one gives the text back.
    """
    get = _with_vocabulary(docs.sparkSession, path)

    def run(batches):
        vocabulary = get()
        for pdf in batches:
            rows, size = [], 0
            texts = [t or "" for t in pdf["text"]]
            for doc_id, text, (ids, scores, changes) in zip(pdf["doc_id"], texts, vocabulary.encode_all(texts, n)):
                digest = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                other = [[{"word": k, "at": at, "old": old, "ids": list(x)} for k, at, old, x in c] for c in changes[1:]] if with_alternatives else None
                rows.append((doc_id, len(ids), ids if with_ids else None, digest, scores, other, vocabulary.decode(ids) == text))
                size += len(ids)
                if size > 1_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "n_pieces", "ids", "ids_sha256", "scores", "alternatives", "round_trip"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, ids array<int>, ids_sha256 string, scores array<double>, alternatives array<array<struct<word: int, at: int, old: int, ids: array<int>>>>, round_trip boolean"
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def segmentations(ids, alternatives) -> list[list[int]]:
    """Ids of all segmentations of a row, best first."""
    out = [list(ids)]
    for changes in alternatives:
        other = list(ids)
        for c in reversed(changes):
            other[c["at"] : c["at"] + c["old"]] = c["ids"]
        out.append(other)
    return out


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and the text of its ids."""
    get = _with_vocabulary(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        vocabulary = get()
        return ids.map(lambda x: vocabulary.decode(x) if x is not None and len(x) else "")

    return encoded.select("doc_id", decode("ids").alias("text"))
