"""Alignment of two tokenizers' tokens by a dangling-suffix transducer, and how well id pairs go together in a corpus.

Both token sequences spell the same bytes. The transducer's state is the side that leads and its unmatched bytes, the
residual. The other side's next token either shortens the residual or passes it and leads from then on; each such step is a
link (the two tokens overlap), and an empty residual closes a group. Transitions are kept by (side, residual, token). New
chunks go through it in step: each of them makes one transition at a time, looked up for all at once.

A space behind a letter, a number or visible ASCII ends a token on both sides, and so a group: each distinct chunk of text
between such spaces is encoded and aligned once by a task, and texts are put together from chunks (a text with a chunk that
isn't spelt by its tokens is aligned as a whole).

1. Texts become blocks of some MB: a row a text with the places of its chunks in the block's list, and with the block's
   first row the distinct id pairs of the block and their numbers of links. Places are packed, those met often in a byte.
2. Numbers are summed by pair over the blocks. A pair is in a block at most once, so no pair is hot: it has a row a block.
3. Sums go back to the blocks' pairs by one join, and each block meets its answers by the block's number.

Null and empty texts, and those whose tokens' bytes differ from space + text, have no tokens: zeros and ''. A very long text is a
block of its own. Repeated rows are documents of their own, an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import byte_level, byte_letters, chunks_of, some_at_once
from .common import small_batches, text_or_empty, written

LOW = (1 << 32) - 1
_aligners: dict[tuple[str, str], Aligner] = {}


class Transducer:
    """Groups and links of two sequences of tokens, given the bytes of both vocabularies."""

    def __init__(self, a: list[bytes], b: list[bytes], most: int = 1_000_000):
        self.bytes, self.most = (a, b), most
        self.seen: dict[tuple[int, bytes, int], tuple[int, bytes]] = {}
        self._forget()

    def step(self, lead: int, residual: bytes, token: int) -> tuple[int, bytes]:
        """The state after the other side's next token: who leads, and what of it is unmatched."""
        key = (lead, residual, token)
        after = self.seen.get(key)
        if after is None:
            piece = self.bytes[1 - lead][token]
            if residual.startswith(piece):
                after = lead, residual[len(piece) :]
            elif piece.startswith(residual):
                after = 1 - lead, piece[len(residual) :]
            else:
                raise ValueError("tokens of the two sides spell different bytes")
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[key] = after
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """Groups as text (`a1,a2|b1`), and each link's ids as id of a << 32 | id of b, in order."""
        a_bytes, seen, step = self.bytes[0], self.seen, self.step
        a_names, b_names = list(map(str, a)), list(map(str, b))
        groups: list[str] = []
        links: list[int] = []
        i = j = 0
        try:
            while i < len(a):
                head, token = a[i], b[j]
                links.append(head << 32 | token)
                lead, residual = seen.get((0, a_bytes[head], token)) or step(0, a_bytes[head], token)
                if not residual:  # both begin and end together
                    groups.append(f"{a_names[i]}|{b_names[j]}")
                    i += 1
                    j += 1
                    continue
                first_a, first_b = i, j
                if lead:
                    head = token
                i += 1
                j += 1
                while residual:
                    if lead:
                        token = a[i]
                        i += 1
                        links.append(token << 32 | head)
                    else:
                        token = b[j]
                        j += 1
                        links.append(head << 32 | token)
                    now, residual = seen.get((lead, residual, token)) or step(lead, residual, token)
                    if now != lead:
                        lead, head = now, token
                groups.append(f"{','.join(a_names[first_a:i])}|{','.join(b_names[first_b:j])}")
        except IndexError:
            j = -1
        if j != len(b):
            raise ValueError("tokens of the two sides spell different bytes")
        return groups, links

    def _state(self, lead: int, residual: bytes) -> int:
        """The number of a state; 0 is the empty residual, whoever led."""
        if not residual:
            return 0
        number = self.numbers.setdefault((lead, residual), len(self.states))
        if number == len(self.states):
            self.states.append((lead, residual))
        return number

    def _forget(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.first = np.full(len(self.bytes[0]), -1, np.int64)
        self.keys, self.next = np.array([-1]), np.zeros(1, np.int64)

    def _after(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """step() of many states at once, by a sorted table of the transitions met so far."""
        key = state << 32 | token
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        missed = key[self.keys[at] != key]
        if len(missed):
            new = np.unique(missed)
            found = [self._state(*self.step(*self.states[k >> 32], k & LOW)) for k in new.tolist()]
            keys = np.concatenate([self.keys, new])
            order = np.argsort(keys)
            self.keys, self.next = keys[order], np.concatenate([self.next, found])[order]
            at = np.searchsorted(self.keys, key)
        return self.next[at]

    def align_all(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """align() of many stretches in step: a and b hold their tokens one after the other, n_a and n_b say how many are whose.

        Each stretch must be spelt alike by both, without empty tokens. Returns which tokens of a and of b end a group, all links by stretch, and how many are whose.
        """
        if max(len(self.states), len(self.keys)) > self.most:
            self._forget()
        end = np.cumsum(n_a)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        who, i, j = np.arange(len(n_a)), end - n_a, np.cumsum(n_b) - n_b
        state, head = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            fresh = np.flatnonzero(state == 0)
            head[fresh] = begun = a[i[fresh]]
            i[fresh] += 1
            for t in np.unique(begun[self.first[begun] < 0]).tolist():
                self.first[t] = self._state(0, self.bytes[0][t])
            state[fresh] = self.first[begun]
            of_a = np.array([lead for lead, _ in self.states], bool)[state]
            token = np.empty(len(who), np.int64)
            token[of_a], token[~of_a] = a[i[of_a]], b[j[~of_a]]
            i += of_a
            j += ~of_a
            steps.append((who, np.where(of_a, token << 32 | head, head << 32 | token)))
            state = self._after(state, token)
            turned = np.array([lead for lead, _ in self.states], bool)[state] != of_a
            head = np.where(turned, token, head)
            closed = state == 0
            last_a[i[closed] - 1] = last_b[j[closed] - 1] = True
            going = ~closed | (i < end[who])
            who, i, j, state, head = who[going], i[going], j[going], state[going], head[going]
        n_links = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(n_a)) if steps else np.zeros(0, np.int64)
        start, links = np.cumsum(n_links) - n_links, np.empty(n_links.sum(), np.int64)
        for k, (w, link) in enumerate(steps):
            links[start[w] + k] = link
        return last_a, last_b, links, n_links


class ByteLevel:
    """ids of chunks by byte-level BPE: the library's, by way of a quicker one for ASCII where ids are in order of merging."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        byte_level(spec)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max(vocab.values()))
        for piece, i in vocab.items():
            self.bytes[i] = bytes(map(letters.__getitem__, piece))
        self.lengths = np.array(list(map(len, self.bytes)))
        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = True  # their strings are plain text
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranks = {raw: i for i, raw in enumerate(self.bytes) if raw}
        in_order = [vocab[a + b] for a, b in merges] == list(range(256, 256 + len(merges))) and len(ranks) == len(vocab)
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if in_order else None

    def encode(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks in another order, all their ids one after the other, how many are whose. Chunks behind which a border may be are encoded as one text."""
        plain, other, rest = [], [], []
        for c in chunks:
            end = c[-1]
            if len(c) >= 1000 or not ("!" <= end <= "~" or end.isalnum()):
                rest.append(c)
            elif self.quick and c.isascii():
                plain.append(c)
            else:
                other.append(c)
        runs = [(part, self.quick("".join(part))) for part in _parts(plain)]
        runs += [(part, self.library.encode("".join(part), add_special_tokens=False).ids) for part in _parts(other)]
        runs += [([c], e.ids) for c, e in zip(rest, self.library.encode_batch(rest, add_special_tokens=False), strict=True)]
        ids = np.fromiter(chain.from_iterable(found for _, found in runs), np.int64)
        order = [c for part, _ in runs for c in part]
        ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum(list(map(len, map(str.encode, order))))
        until = np.searchsorted(ends, wanted)
        if len(order) and (until[-1] != len(ids) - 1 or not np.array_equal(ends[until], wanted)):
            raise ValueError("this tokenizer's tokens cross the borders of chunks")
        return order, ids, np.diff(until, prepend=-1) if len(order) else np.zeros(0, np.int64)


def _parts(chunks: list[str], most: int = 1000) -> Iterator[list[str]]:
    return (chunks[i : i + most] for i in range(0, len(chunks), most))


class Aligner:
    """Both tokenizers and the chunks a task has aligned, by number; of some `most` chunks those met most often stay."""

    COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "links")

    def __init__(self, a: str, b: str, most: int = 240_000, longest: int = 40, in_step: int = 64):
        import sentencepiece

        self.a, self.b = ByteLevel(a), sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or self.b.encode("a") != [self.b.piece_to_id("▁a")]:
            raise ValueError("pieces of this model cross white-space markers, or it adds no leading one")
        b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer, self.mark = Transducer(self.a.bytes, b_bytes), self.b.piece_to_id("▁")
        self.b_lengths = np.array(list(map(len, b_bytes)))
        self.names = np.array([str(i) for i in range(max(len(self.a.bytes), len(b_bytes)))], object)
        self.most, self.longest, self.in_step, self.made = most, longest, in_step, 0
        self.table: dict[str, int] = {}
        self.groups: list[str] = []
        self.held: dict[str, list[np.ndarray]] = {c: [] for c in self.COLUMNS}
        self.uses = np.zeros(0, np.int64)

    def column(self, name: str) -> np.ndarray:
        """What is known of all chunks by number; links are those of all chunks one after the other."""
        parts = self.held[name]
        if len(parts) != 1:
            parts[:] = [np.concatenate([np.zeros(0, np.int64), *parts])]
        return parts[0]

    def _keep(self, groups: list[str], **columns: np.ndarray) -> None:
        self.groups += groups
        for c in self.COLUMNS:
            self.held[c].append(columns[c])

    @staticmethod
    def _spelt(chunks: list[str], ids: np.ndarray, n: np.ndarray, known: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Which chunks their tokens spell."""
        text, end = b"".join(map(known.__getitem__, ids.tolist())), np.concatenate([[0], np.cumsum(lengths[ids])])[np.cumsum(n)]
        wanted = list(map(str.encode, chunks))
        if text == b"".join(wanted) and np.array_equal(end, np.cumsum(list(map(len, wanted)))):
            return np.ones(len(chunks), bool)
        end = end.tolist()
        return np.array([text[x:y] == w for x, y, w in zip([0, *end], end, wanted)], bool)

    def learn(self, chunks: list[str]) -> None:
        """Each chunk, which begins with a space, encoded and aligned; number -1 where its tokens don't spell it."""
        self.made += len(chunks)
        chunks, a, n_a = self.a.encode(chunks)
        of_b = [ids if len(c) > 1 else [self.mark] for c, ids in zip(chunks, self.b.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
        b, n_b = np.fromiter(chain.from_iterable(of_b), np.int64), np.array(list(map(len, of_b)), np.int64)
        spelt = self._spelt(chunks, a, n_a, self.transducer.bytes[0], self.a.lengths) & self._spelt(chunks, b, n_b, self.transducer.bytes[1], self.b_lengths)
        empty = [np.bincount(np.repeat(np.arange(len(n)), n)[length[ids] == 0], minlength=len(n)) > 0 for ids, n, length in ((a, n_a, self.a.lengths), (b, n_b, self.b_lengths))]
        long = (n_a + n_b > self.in_step) | empty[0] | empty[1]
        self._learn_in_step(chunks, a, n_a, b, n_b, spelt & ~long)
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        for i in np.flatnonzero(spelt & long).tolist():
            try:
                groups, links = self.transducer.align(a[ends_a[i] - n_a[i] : ends_a[i]].tolist(), b[ends_b[i] - n_b[i] : ends_b[i]].tolist())
            except ValueError:
                spelt[i] = False
                continue
            self.table[chunks[i]] = len(self.groups)
            one = {"n_a": n_a[i : i + 1], "n_b": n_b[i : i + 1], "n_groups": np.array([len(groups)]), "n_links": np.array([len(links)]), "links": np.array(links, np.int64)}
            self._keep([";".join(groups)], **one)
        for i in np.flatnonzero(~spelt).tolist():
            self.table[chunks[i]] = -1

    def _learn_in_step(self, chunks: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, chosen: np.ndarray) -> None:
        if not chosen.any():
            return
        a, b, n_a, n_b = a[np.repeat(chosen, n_a)], b[np.repeat(chosen, n_b)], n_a[chosen], n_b[chosen]
        last_a, last_b, links, n_links = self.transducer.align_all(a, n_a, b, n_b)
        # Groups as text: a token's place is behind all tokens of earlier groups, and one of b behind its group's of a.
        end_a, end_b, until = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1, np.cumsum(n_b)
        at_a = np.arange(len(a)) + np.concatenate([[0], end_b])[np.cumsum(last_a) - last_a]
        at_b = np.arange(len(b)) + end_a[np.cumsum(last_b) - last_b]
        text, width = np.empty(2 * (len(a) + len(b)), object), np.ones(2 * (len(a) + len(b)), np.int64)
        for at, ids in ((at_a, a), (at_b, b)):
            text[2 * at] = self.names[ids]
            width[2 * at] = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
        text[1::2] = ","
        text[2 * at_a[last_a] + 1], text[2 * at_b[last_b] + 1] = "|", ";"
        whole, end = "".join(text.tolist()), np.cumsum(width)[2 * at_b[until - 1] + 1].tolist()
        own = [c for c, x in zip(chunks, chosen.tolist(), strict=True) if x]
        self.table.update(zip(own, range(len(self.groups), len(self.groups) + len(own)), strict=True))
        n_groups = np.diff(np.concatenate([[0], np.cumsum(last_a)])[np.concatenate([[0], np.cumsum(n_a)])])
        self._keep([whole[x : y - 1] for x, y in zip([0, *end], end)], n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, links=links)

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' chunks by position, and how many are whose; none for a text without tokens."""
        split = [chunks_of(f" {t}") if t else [] for t in texts]
        chunks, counts = list(chain.from_iterable(split)), np.array(list(map(len, split)), np.int64)
        get = self.table.get
        numbers = np.fromiter(map(get, chunks, repeat(-2)), np.int64, len(chunks))
        unknown = np.flatnonzero(numbers == -2).tolist()
        if unknown:
            new = list(dict.fromkeys(map(chunks.__getitem__, unknown)))
            self.learn(new)
            numbers[unknown] = [get(chunks[i]) for i in unknown]
            for c in new:
                if len(c) > self.longest:
                    self.table.pop(c, None)
        if len(numbers) and numbers.min() < 0:
            parts = np.split(numbers, np.cumsum(counts)[:-1])
            for i in {np.searchsorted(np.cumsum(counts), k, "right") for k in np.flatnonzero(numbers < 0).tolist()}:
                known = self.table.pop(whole := f" {texts[i]}", None)
                self.learn([whole])
                found = self.table.pop(whole)
                if known is not None:
                    self.table[whole] = known
                parts[i] = np.array([found] if found >= 0 else [], np.int64)
            numbers, counts = np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        return numbers, counts

    def settled(self, distinct: np.ndarray, often: np.ndarray) -> None:
        """Counts a block's chunks, and with over `most` chunks (or 16 links for each) forgets those met least; numbers change then."""
        self.uses = np.concatenate([self.uses, np.zeros(len(self.groups) - len(self.uses), np.int64)])
        self.uses[distinct] += often
        size = self.column("n_links")
        if len(self.groups) <= self.most and size.sum() <= 16 * self.most:
            return
        kept = np.array([n for n in self.table.values() if n >= 0], np.int64)
        least = 2
        while np.count_nonzero(self.uses[kept] >= least) > self.most // 2 or size[kept][self.uses[kept] >= least].sum() > 8 * self.most:
            least *= 2
        stays = np.zeros(len(self.groups), bool)
        stays[kept] = self.uses[kept] >= least
        place, flags = (np.cumsum(stays) - 1).tolist(), stays.tolist()
        self.table = {c: place[n] for c, n in self.table.items() if n >= 0 and flags[n]}
        self.groups = [g for g, x in zip(self.groups, flags, strict=True) if x]
        for c in self.COLUMNS:
            self.held[c] = [self.column(c)[np.repeat(stays, size) if c == "links" else stays]]
        self.uses = self.uses[stays] // 2


def aligner_of(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 as bytes of seven bits, the lowest first, with the eighth bit in all but a number's last; and how many bytes each takes."""
    width = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    start, out = np.cumsum(width) - width, np.empty(width.sum(), np.uint8)
    for k in range(5):
        own = width > k
        out[start[own] + k] = numbers[own] >> 7 * k & 127 | (width[own] > k + 1) << 7
    return out, width


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers whose bytes packed() gave."""
    end = np.flatnonzero(data < 128)
    start = np.concatenate([[0], end + 1])[:-1]
    out = (data[start] & 127).astype(np.int64)
    for k in range(1, 5):
        own = np.flatnonzero(end - start >= k)
        out[own] |= (data[start[own] + k] & 127).astype(np.int64) << 7 * k
    return out


def _forget_aligners() -> None:
    """Workers go on from the blocks' tasks to others: those need no tokenizers and chunks, whose memory the system gets back."""
    if _aligners:
        _aligners.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


class Block:
    """Rows of some texts together, and the distinct chunks and id pairs of them."""

    NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunks")

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.ids: list = []
        self.digests: list[str] = []
        self.counts: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []  # of all texts' chunks, one after the other
        self.size = 0

    def add(self, ids: list, texts: list[str]) -> None:
        numbers, counts = self.aligner.aligned(texts)
        groups, at = list(map(self.aligner.groups.__getitem__, numbers.tolist())), 0
        for n in counts.tolist():
            self.digests.append(hashlib.sha256(";".join(groups[at : at + n]).encode()).hexdigest() if n else "")
            at += n
        self.ids += ids
        self.counts.append(counts)
        self.numbers.append(numbers)
        self.size += sum(map(len, texts))

    def batches(self, number: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row a text; the first one also has the block's pairs, how often each occurs, and each chunk's links as places among the pairs."""
        numbers, known = np.concatenate(self.numbers), self.aligner.column
        met = np.bincount(numbers, minlength=len(self.aligner.groups))
        distinct = np.flatnonzero(met)
        distinct = distinct[np.argsort(-met[distinct], kind="stable")]  # what comes often has a small place, which takes a byte
        place = np.zeros(len(met), np.int64)
        place[distinct] = np.arange(len(distinct))
        often, at = met[distinct], place[numbers]
        own = {c: known(c)[distinct] for c in ("n_a", "n_b", "n_groups", "n_links")}
        size = own["n_links"]
        start = (np.cumsum(known("n_links")) - known("n_links"))[distinct]
        links = known("links")[np.repeat(start - (np.cumsum(own["n_links"]) - own["n_links"]), own["n_links"]) + np.arange(own["n_links"].sum())]
        self.aligner.settled(distinct, often)
        pairs, link = np.unique(links, return_inverse=True)
        times = np.bincount(link, np.repeat(often, size), len(pairs)).astype(np.int64)
        order = np.argsort(-times, kind="stable")
        pairs, times, link = pairs[order], times[order], np.argsort(order)[link]
        ends = np.cumsum(np.concatenate([[0], *self.counts]))
        sums = {}
        for name, values in own.items():
            along = np.concatenate([[0], np.cumsum(values[at])])
            sums[name] = along[ends[1:]] - along[ends[:-1]]
        more = {"pairs": (pairs, pa.list_(pa.int64())), "times": (times, pa.list_(pa.int64())), "links": (packed(link)[0].tobytes(), pa.binary()), "sizes": (packed(size)[0].tobytes(), pa.binary())}
        chunks, width = packed(at)
        ends = np.concatenate([[0], np.cumsum(width)])[ends]
        for x in range(0, len(self.ids), 2000):
            y = min(x + 2000, len(self.ids))
            own_chunks = pa.Array.from_buffers(pa.binary(), y - x, [None, *map(pa.py_buffer, ((ends[x : y + 1] - ends[x]).astype(np.int32), chunks[ends[x] : ends[y]]))])
            arrays = [pa.array([number] * (y - x), pa.int64()), pa.array(self.ids[x:y], id_type), *(pa.array(v[x:y]) for v in sums.values()), pa.array(self.digests[x:y], pa.string()), own_chunks]
            arrays += [pa.array([v if x + i == 0 else None for i in range(y - x)], kind) for v, kind in more.values()]
            yield pa.RecordBatch.from_arrays(arrays, ["block", *self.NAMES, *more])


def _blocks(a: str, b: str, block_bytes: int, at_once: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, kind = aligner_of(a, b), None
        block = Block(aligner)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, kind = batch.column("doc_id"), batch.schema.field("doc_id").type
            at = 0
            for texts in some_at_once((t.as_py() for t in batch.column("t")), min(at_once, block_bytes)):
                block.add(ids.slice(at, len(texts)).to_pylist(), texts)
                at += len(texts)
                if block.size > block_bytes:
                    yield from block.batches(number, kind)
                    block, number = Block(aligner), number + 1
        if block.ids:
            yield from block.batches(number, kind)

    return run


def _answered(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's rows with the sums over their links; answers holds each of its pairs' count and whether that is its B id's highest."""
    _forget_aligners()
    first = rows.column("links").is_valid().to_numpy().argmax()
    links, sizes = (unpacked(np.frombuffer(rows.column(c)[int(first)].as_py(), np.uint8)) for c in ("links", "sizes"))
    chunks = rows.column("chunks").cast(pa.binary()).combine_chunks()
    border, data = (np.frombuffer(x or b"", kind) for x, kind in zip(chunks.buffers()[1:], (np.int32, np.uint8), strict=True))
    border = border[chunks.offset : chunks.offset + len(chunks) + 1]
    data = data[border[0] : border[-1]]
    at, ends = unpacked(data), np.concatenate([[0], np.cumsum(data < 128)])[border - border[0]]
    order = np.argsort(answers.column("place").to_numpy())
    sums = {}
    for name in ("best", "count"):
        value = answers.column(name).to_numpy().astype(np.int64)[order]
        along = np.concatenate([[0], np.cumsum(value[links])]) if len(links) else np.zeros(1, np.int64)
        end = np.cumsum(sizes)
        chunk = along[end] - along[end - sizes] if len(sizes) else np.zeros(0, np.int64)
        along = np.concatenate([[0], np.cumsum(chunk[at])])
        sums[name] = pa.array(along[ends[1:]] - along[ends[:-1]], pa.int64())
    keep = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return keep.append_column("n_best", sums["best"]).append_column("count_sum", sums["count"]).append_column("groups_sha256", rows.column("groups_sha256"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count) of all links in the corpus."""
    rows = blocks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))


def aligned(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; a is the path of a byte-level .json, b of a SentencePiece .model."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary, pairs array<long>, times array<long>, links binary, sizes binary"
    with small_batches(docs.sparkSession):
        blocks = written(rows.mapInArrow(_blocks(a, b, block_bytes), shape), "blocks")
    counts = pair_counts(blocks)
    # A B id has at most as many pairs as A has ids.
    best = F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(LOW)))
    judged = counts.select("pair", "count", best.alias("best"))
    asked = blocks.where("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    # Judged pairs are no more than the two vocabularies have in common, whatever the corpus: a task holds its part in a table, and the blocks' many pairs aren't sorted.
    answers = asked.join(judged.hint("shuffle_hash"), "pair").select("of", "place", "count", "best")
    texts = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunks", "links", "sizes")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_answered, out)
