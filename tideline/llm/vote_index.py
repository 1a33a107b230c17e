"""Inverted index over labelled examples, and votes of the nearest (numpy, inside tasks)."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np

from .textkit import plain_keys_and_heads

#: Words that share a stem share a head.
HEADS = (4, 5, 6, 7)
#: Vectors are dealt into so many groups of like vectors; terms that more than this share of a group have are dense rows
#: there, its commonest so many at most, and postings elsewhere.
GROUPS, COMMON, MAX_DENSE = 6, 0.1, 1_500
#: Commonest terms by which vectors are dealt, and parts in which postings are made.
DEALT_BY, PARTS = 700, 32
#: Texts that are scored at once, and postings up to which a term's are taken one by one rather than as a run.
TOGETHER, SHORT = 256, 64
#: Examples that may vote, and the numbers of voters that leave-one-out votes choose from.
NEIGHBOURS = 15
VOTERS = (3, 5, 8, 11, NEIGHBOURS)
#: Examples whose leave-one-out votes choose the number of voters and calibrate, drawn by their ids.
CALIBRATED = 2_000
#: Added to the cosine distance before it is inverted to a vote's weight.
SOFTEN = 0.05


def features(text: str | None) -> np.ndarray:
    """Keys of the words and of the heads of longer words, one for each time they stand in the text."""
    return plain_keys_and_heads(text, HEADS)


class Lookup:
    """Places of keys among sorted keys; they are spread evenly, so their leading bits lead to a few of them."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(len(keys), 1).bit_length() + 1
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.start = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.intp), minlength=1 << bits))]).astype(np.int32)

    def find(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some keys are known, and their places."""
        lead = (some >> self.shift).astype(np.intp)
        at, end = self.start.take(lead), self.start.take(lead + 1)
        known = np.zeros(len(some), bool)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys.take(at[left]) == some[left]
            known[left[hit]] = True
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        known = np.flatnonzero(known)
        return known, at[known]


def vector(text: str | None, lookup: Lookup, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of the text's unit TF-IDF vector over the terms of ``lookup``."""
    keys, times = np.unique(features(text), return_counts=True)
    known, at = lookup.find(keys)
    return unit(at, times[known], idf)


def unit(which: np.ndarray, times: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of the unit vector of terms and their counts."""
    weight = (1.0 + np.log(times, dtype=np.float64)) * idf[which]
    return which, weight / np.sqrt(np.sum(weight**2)) if len(weight) else weight


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: a waiting process would keep it from the executor."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def like_groups(unit_rows: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each column of unit length: k-means by cosine, started from columns far from each other."""
    centres = unit_rows[:, :1]
    for _ in range(groups - 1):
        centres = np.column_stack([centres, unit_rows[:, np.argmin((centres.T @ unit_rows).max(axis=0))]])
    for _ in range(rounds):
        near = np.argmax(centres.T @ unit_rows, axis=0)
        centres = np.column_stack([unit_rows[:, near == g].sum(axis=1) for g in range(groups)])
        centres /= np.maximum(np.linalg.norm(centres, axis=0), 1e-9)
    return np.argmax(centres.T @ unit_rows, axis=0)


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions first, first + 1, ... of all runs, one after another."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


class VoteIndex:
    """Distinct vectors as postings by term; the commonest terms of a group of like vectors as its dense rows.

    Sums over postings, and over rows in single precision, find the vectors that may be nearest; their dense terms are
    then summed in double precision, so groups and rounding decide nothing.
    """

    def __init__(self, n_terms: int, vectors: list[tuple[np.ndarray, np.ndarray, float, float, int]], idf: np.ndarray | None = None) -> None:
        """vectors: term positions, weights, weight of label 1, weight of label 0, example id; sorted by it.

        With ``idf`` the second entry is the terms' counts, of which weights are made.
        """
        self.vectors = sorted(vectors, key=lambda v: v[4])
        self.n = len(self.vectors)
        self.yes = np.array([v[2] for v in self.vectors])
        self.total = np.array([v[2] + v[3] for v in self.vectors])
        self.ids = [v[4] for v in self.vectors]
        self.idf, self.n_terms = idf, n_terms
        most = max((int(v[1].max(initial=0)) for v in self.vectors), default=0) if idf is not None else 0
        #: Weight of a count before the term's and the vector's factors.
        self.damped = 1.0 + np.log(np.maximum(np.arange(most + 1), 1))
        self.scale = np.ones(self.n)
        if idf is not None:
            for i, (which, times, *_) in enumerate(self.vectors):
                if len(which):
                    self.scale[i] = 1.0 / np.sqrt(np.sum((self.damped.take(times) * idf.take(which)) ** 2))
        self._deal()
        self._runs()
        self.scale = self.scale[self.order]

    def _weights(self, i: int) -> np.ndarray:
        which, entry = self.vectors[i][:2]
        return entry if self.idf is None else self.damped.take(entry) * self.idf.take(which) * self.scale[i]

    def _commonest(self, vectors: np.ndarray, most: int, share: float) -> np.ndarray:
        held = np.zeros(self.n_terms, np.int32)
        for i in vectors.tolist():
            held[self.vectors[i][0]] += 1
        common = np.flatnonzero(held > share * len(vectors))
        return common[np.argsort(-held[common], kind="stable")[:most]]

    def _deal(self) -> None:
        """Groups of vectors, by their commonest terms, and the dense rows of each group."""
        everyone = np.arange(self.n)
        common = self._commonest(everyone, DEALT_BY, 0.01)
        place = np.full(self.n_terms, -1, np.int32)
        place[common] = np.arange(len(common))
        group = np.zeros(self.n, np.int8)
        if len(common) and self.n >= 2 * GROUPS:
            rows = np.zeros((len(common), self.n), np.float32)
            for i, (which, *_) in enumerate(self.vectors):
                at = place.take(which)
                held = at >= 0
                rows[at[held], i] = self._weights(i)[held]
            rows /= np.maximum(np.sqrt(np.einsum("ij,ij->j", rows, rows)), 1e-9)
            group = like_groups(rows, GROUPS).astype(np.int8)
            del rows
        #: Vectors of each group; they lie behind each other in ``order`` and in the sums over a text.
        members = [own for g in range(GROUPS) if len(own := np.flatnonzero(group == g))]
        found = [self._commonest(own, MAX_DENSE, COMMON) for own in members]
        self.order = np.concatenate([*members, everyone[:0]])
        self.edge = np.cumsum([0, *(len(own) for own in members)]).tolist()
        self.rank = np.empty(self.n, np.int64)
        self.rank[self.order] = everyone
        #: Place of the terms that are dense in some group, and the row of such a place in each group.
        some = np.unique(np.concatenate([*found, everyone[:0]]))
        place.fill(-1)
        place[some] = np.arange(len(some))
        self.place = place
        self.row = np.full((len(found), len(some)), -1, np.int32)
        self.dense = []
        #: Places and entries of the dense terms of each vector, for the exact sums.
        places, entries = [], []
        for row, own, terms in zip(self.row, members, found, strict=True):
            row[place[terms]] = np.arange(len(terms))
            rows = np.zeros((len(terms), len(own)), np.float32)
            for column, i in enumerate(own.tolist()):
                which, entry = self.vectors[i][:2]
                at = place.take(which)
                held = np.flatnonzero(at >= 0)
                at = at[held]
                dense = row.take(at)
                if len(dense) and dense.min() < 0:
                    mine = dense >= 0
                    held, at, dense = held[mine], at[mine], dense[mine]
                entry = entry[held]
                rows[dense, column] = entry if self.idf is None else self.damped.take(entry) * self.idf.take(which[held]) * self.scale[i]
                places.append(at.astype(np.min_scalar_type(len(some))))
                entries.append(entry)
            self.dense.append(rows)
        self.held_edge = np.cumsum([0, *(len(p) for p in places)])
        self.held_place = np.concatenate(places) if places else self.order
        self.held_entry = np.concatenate(entries) if places else self.order

    def _runs(self) -> None:
        """The other entries as vectors by term, those with equal entries as a run, so that a run has one weight."""
        kinds = np.unique(np.concatenate([np.empty(0, self.vectors[0][1].dtype) if self.n else np.empty(0), *(np.unique(v[1]) for v in self.vectors)]))
        of = np.repeat(np.arange(len(self.dense)), np.diff(self.edge))
        parts, ends, values, terms, done = [], [np.zeros(1, np.int64)], [], [], 0
        bounds = np.unique(np.linspace(0, self.n_terms, PARTS + 1).astype(np.int64))
        # Vectors hold their terms in order, so a part of the terms is a piece of each; parts need less room at once.
        cuts = np.array([np.searchsorted(v[0], bounds) for v in self.vectors]).reshape(self.n, len(bounds))
        for p in range(len(bounds) - 1):
            a, z = cuts[:, p], cuts[:, p + 1]
            which = np.concatenate([np.empty(0, np.int32), *(v[0][x:y] for v, x, y in zip(self.vectors, a.tolist(), z.tolist(), strict=True))])
            entry = np.concatenate([kinds[:0], *(v[1][x:y] for v, x, y in zip(self.vectors, a.tolist(), z.tolist(), strict=True))])
            who = np.repeat(self.rank.astype(np.min_scalar_type(max(self.n - 1, 0))), z - a)
            place = self.place.take(which)
            rare = np.flatnonzero((place < 0) | (self.row[of.take(who), place] < 0)) if self.row.size else np.arange(len(which))
            key = which[rare].astype(np.int64) * len(kinds) + np.searchsorted(kinds, entry[rare])
            if self.n_terms * len(kinds) < 2**62 // max(self.n, 1):  # one sort of whole numbers is several times as fast
                key = np.sort(key * self.n + who[rare])
                parts.append((key % self.n).astype(who.dtype))
                key //= self.n
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
                parts.append(who[rare[order]])
            lead = np.flatnonzero(np.diff(key, prepend=-1))
            ends.append(np.append(lead[1:], len(key))[: len(lead)] + done)
            values.append(kinds[key[lead] % len(kinds)] if len(lead) else kinds[:0])
            terms.append(key[lead] // max(len(kinds), 1))
            done += len(key)
        self.who = np.concatenate([np.empty(0, np.min_scalar_type(max(self.n - 1, 0))), *parts])
        start = np.concatenate(ends).astype(np.int32 if done < 2**31 else np.int64)
        entry = np.concatenate([kinds[:0], *values])
        first = np.searchsorted(np.concatenate([np.empty(0, np.int64), *terms]), np.arange(self.n_terms + 1))
        #: Terms by number of postings, so that what most texts look up lies together; ``number`` is a term's place there.
        order = np.argsort(start[first[:-1]] - start[first[1:]], kind="stable")
        self.number = np.empty(self.n_terms, np.int32)
        self.number[order] = np.arange(self.n_terms)
        runs = (first[1:] - first[:-1])[order]
        moved = spread(first[:-1][order], runs)
        #: A run's vectors begin at ``start``, are ``size`` many and hold ``entry``; a term's runs begin at ``first``.
        self.start, self.size, self.entry = start[moved], (start[1:] - start[:-1])[moved], entry[moved]
        self.first = np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)
        self.posts = start[first[1:]][order] - start[first[:-1]][order]
        #: Terms before this number are copied as runs, those before the next one by one, the rest have no postings.
        self.long, self.some = int(np.count_nonzero(self.posts > SHORT)), int(np.count_nonzero(self.posts))

    def _posted(self, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums over the postings of one text."""
        number = self.number.take(which)
        order = np.argsort(number)
        number, weight = number[order], weight[order]
        many, held = np.searchsorted(number, (self.long, self.some)).tolist()
        if not held:
            return np.zeros(self.n)
        number, weight = number[:held], weight[:held]
        first, posts = self.first.take(number), self.posts.take(number)
        each = self.first.take(number + 1) - first
        a = self.start.take(first)
        runs = spread(first, each)
        entry = self.entry.take(runs)
        value = np.repeat(weight, each)
        value *= entry if self.idf is None else self.damped.take(entry)
        value = np.repeat(value, self.size.take(runs))
        # Postings of a term lie together: copying runs is cheaper than an index of all of them, but for short ones.
        parts = [self.who[x : x + y] for x, y in zip(a[:many].tolist(), posts[:many].tolist(), strict=True)]
        parts.append(self.who.take(spread(a[many:], posts[many:])))
        return np.bincount(np.concatenate(parts).astype(np.intp), value, minlength=self.n)

    def _near(self, common: np.ndarray) -> np.ndarray:
        """The part of the dense rows in the cosines of a few texts, but for the rounding of single precision."""
        common = common.astype(np.float32)
        out = np.zeros((len(common), self.n), np.float32)
        met = common.any(axis=0)
        for a, z, row, rows in zip(self.edge[:-1], self.edge[1:], self.row, self.dense, strict=True):
            at = np.flatnonzero(met & (row >= 0))
            if len(at):
                used, few = row[at], 3 * len(at) < 2 * len(rows)
                part = np.zeros((len(common), len(at) if few else len(rows)), np.float32)
                part[:, slice(None) if few else used] = common[:, at]
                np.matmul(part, rows[used] if few else rows, out=out[:, a:z])
        return out

    def nearest_all(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the positions and cosines of the k nearest vectors with a term in common, exactly; ties go to the lower position."""
        found = [(np.empty(0, np.int64), np.empty(0))] * len(texts)
        # All terms of a sum are positive, so its relative error is at most about that of as many roundings as it has terms.
        slack = 4.0 * np.finfo(np.float32).eps * (10 + max((len(r) for r in self.dense), default=0))
        spots = []
        for which, _ in texts:
            place = self.place.take(which)
            at = np.flatnonzero(place >= 0)
            spots.append((at, place[at]))
        # Texts that meet the dense rows of the same group come together.
        held = (self.row >= 0).astype(np.float32)
        met = np.array([int(np.argmax(held[:, place].sum(axis=1))) if len(held) else 0 for _, place in spots], np.int64)
        alike = [np.flatnonzero(met == g).tolist() for g in np.unique(met)]
        for some in (own[lead : lead + TOGETHER] for own in alike for lead in range(0, len(own), TOGETHER)):
            common = np.zeros((len(some), self.row.shape[1]))
            for part, i in zip(common, some, strict=True):
                part[spots[i][1]] = texts[i][1][spots[i][0]]
            for i, part, score in zip(some, common, self._near(common), strict=True):
                which, weight = texts[i]
                if self.idf is not None:
                    weight = weight * self.idf.take(which)
                posted = self._posted(which, weight)
                posted *= self.scale
                score = posted + score
                least = np.partition(score, self.n - k)[self.n - k] if self.n > k else 0.0
                near = np.flatnonzero(score >= max(least * (1.0 - slack), 1e-300))
                if len(near):
                    part[spots[i][1]] = weight[spots[i][0]]
                    # Sums differ in their last bits by their order; equal vectors get equal cosines.
                    cosine = np.round(posted[near] + self.scale[near] * self._held(part, near), 12)
                    at = self.order[near]
                    best = np.lexsort((at, -cosine))[:k]
                    found[i] = at[best], cosine[best]
        return found

    def _held(self, common: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The part of the dense terms in the cosines with a few vectors, in double precision and before their scale."""
        first, size = self.held_edge[near], self.held_edge[near + 1] - self.held_edge[near]
        at = spread(first, size)
        entry = self.held_entry.take(at)
        value = common.take(self.held_place.take(at)) * (entry if self.idf is None else self.damped.take(entry))
        return np.bincount(np.repeat(np.arange(len(near)), size), value, minlength=len(near))

    def nearest(self, which: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text."""
        return self.nearest_all([(which, weight)], k)[0]

    def vote(self, at: np.ndarray, cosine: np.ndarray, prior: float, without: int = -1, label: float = 0.0, one: float = 0.0) -> float:
        """Distance-weighted share of label 1, drawn to the prior by one vote at distance 1.

        ``without`` takes one example (its label and weight) out of a vector: the leave-one-out vote.
        """
        yes, total = self.yes[at].copy(), self.total[at].copy()
        if without >= 0:
            own = at == without
            yes[own] -= label * one
            total[own] -= one
        used = total > 1e-9
        weight = 1.0 / (SOFTEN + np.maximum(0.0, 1.0 - cosine[used]))
        lone = 1.0 / (SOFTEN + 1.0)
        return float((np.sum(weight * yes[used] / total[used]) + lone * prior) / (np.sum(weight) + lone))


def fit_platt(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logit, by Newton steps on a lightly penalised log likelihood; slope 1 and offset 0 at worst."""
    x = np.log(score / (1 - score))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(weight * (p - label) * x) + (a - 1.0), np.sum(weight * (p - label)) + b])
        v = weight * p * (1 - p)
        h = np.array([[np.sum(v * x * x) + 1.0, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 1.0]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.max(np.abs(step)) < 1e-9:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def squash(slope: float, offset: float, raw: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(slope * np.log(raw / (1 - raw)) + offset, -30, 30)))


class VoteModel:
    """Terms, examples, number of voters, calibration and the share of label 1 among examples without a term.

    Terms and their counts travel to the tasks, which build the index from them: weights would be several times as large.
    """

    def __init__(
        self, terms: np.ndarray, idf: np.ndarray, examples: list[tuple[int, np.ndarray, np.ndarray, int, float]], calibrated: int = CALIBRATED
    ) -> None:
        """examples: id, term positions, their counts, label, weight of the example; ``calibrated`` of them choose the voters."""
        self.terms, self.idf = terms, idf
        examples = sorted(examples, key=lambda e: e[0])
        groups: dict = {}
        none_yes = none_total = yes = total = 0.0
        names = []
        for who, which, times, label, one in examples:
            yes, total = yes + one * label, total + one
            weight = unit(which, times, idf)[1]
            names.append(hashlib.blake2b(np.asarray(which, np.int64).tobytes() + np.round(weight, 12).tobytes(), digest_size=16).digest())
            if not len(which):
                none_yes, none_total = none_yes + one * label, none_total + one
                continue
            w, n, y, z, first = groups.get(names[-1], (which, times, 0.0, 0.0, who))
            groups[names[-1]] = (w, n, y + one * label, z + one * (1 - label), first)
        self.prior = (yes + 0.5) / (total + 1.0)
        self.blank = (none_yes + self.prior) / (none_total + 1.0)
        self.examples = list(groups.values())
        self._held, self._lookup, self.shared, self.shipped = None, None, None, False
        place = {name: i for i, name in enumerate(groups)}
        #: (vector, label, weight) of the examples that calibrate.
        self.held = [(place[name], e[3], e[4]) for e, name in sorted(zip(examples, names, strict=True), key=lambda x: (x[0][0] * 2654435761) % 2**32) if len(e[1])][:calibrated]
        self.voters, self.slope, self.offset = NEIGHBOURS, 1.0, 0.0

    @property
    def index(self) -> VoteIndex:
        """Built where it is first needed; examples stand in the order of their ids, which it keeps."""
        if self._held is None:
            self._held = VoteIndex(len(self.terms), self.examples, self.idf)
            self._held.vectors = []
            if self.shipped:
                # A task needs no examples beside the index but those that calibrate.
                used = {v for v, *_ in self.held}
                self.examples = [(e[0].copy(), e[1].copy()) if i in used else () for i, e in enumerate(self.examples)]
                give_back()
        return self._held

    def __getstate__(self) -> dict:
        which, times, yes, no, ids = ([e[i] for e in self.examples] for i in range(5))
        sizes = [len(w) for w in which]
        flat = [np.concatenate(x) if x else np.empty(0, np.int32) for x in (which, times)]
        return {k: v for k, v in self.__dict__.items() if k not in ("_held", "_lookup", "shared", "examples")} | {"packed": (*flat, sizes, yes, no, ids)}

    def __setstate__(self, state: dict) -> None:
        which, times, sizes, *rest = state.pop("packed")
        self.__dict__.update(state)
        cuts = np.cumsum(sizes)[:-1] if sizes else []
        self.examples = [(w, n, *r) for w, n, *r in zip(np.split(which, cuts), np.split(times, cuts), *rest, strict=True)] if sizes else []
        self._held, self._lookup, self.shared, self.shipped = None, None, None, True

    def left_out(self, some: list[int]) -> np.ndarray:
        """Leave-one-out votes of some of the held examples, a column for each number of voters."""
        rows = [self.held[i] for i in some]
        near = self.index.nearest_all([unit(*self.examples[v][:2], self.idf) for v, *_ in rows], NEIGHBOURS + 1)
        out = np.empty((len(rows), len(VOTERS)))
        for i, ((v, label, one), (at, cosine)) in enumerate(zip(rows, near, strict=True)):
            # The example's own vector votes only if other examples share it.
            lone = (at == v) & (self.index.total[at] - one <= 1e-9)
            at, cosine = at[~lone], cosine[~lone]
            out[i] = [self.index.vote(at[:k], cosine[:k], self.prior, v, label, one) for k in VOTERS]
        return out

    def calibrate(self, votes: np.ndarray) -> VoteModel:
        """Takes the number of voters, slope and offset with the least log loss on the held examples' votes."""
        if len(self.held):
            label, one = np.array([e[1] for e in self.held], float), np.array([e[2] for e in self.held])
            best = None
            for k, voters in enumerate(VOTERS):
                slope, offset = fit_platt(votes[:, k], label, one)
                p = squash(slope, offset, votes[:, k])
                loss = -float(np.sum(one * np.log(np.where(label == 1, p, 1 - p))))
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, voters, slope, offset)
            self.voters, self.slope, self.offset = best[1:]
        return self

    def fitted(self, voters: int, slope: float, offset: float) -> VoteModel:
        """This model with a number of voters and a calibration that were chosen after it was sent."""
        self.voters, self.slope, self.offset = voters, slope, offset
        return self

    def score_all(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float, float]]]]:
        """For each text the calibrated score, and the three nearest examples: id, cosine, share of label 1."""
        if self._lookup is None:
            self._lookup = Lookup(self.terms)
        vectors = [vector(t, self._lookup, self.idf) for t in texts]
        out: list = [(self.blank, [])] * len(texts)
        known = [i for i, v in enumerate(vectors) if len(v[0])] if self.index.n else []
        for i, (at, cosine) in zip(known, self.index.nearest_all([vectors[i] for i in known]), strict=True):
            raw = self.index.vote(at[: self.voters], cosine[: self.voters], self.prior)
            share = self.index.yes[at[:3]] / self.index.total[at[:3]]
            evidence = [(self.index.ids[j], float(min(1.0, c)), float(s)) for j, c, s in zip(at[:3], cosine[:3], share, strict=True)]
            out[i] = (float(squash(self.slope, self.offset, np.array([raw]))[0]), evidence)
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, float]]]:
        """The same for one text."""
        return self.score_all([text])[0]
