"""Abusive, hateful or sexual passages by a linear-chain conditional random field.

A two-label chain (T toxic, O other) is trained on labelled sentences, whose tokens take the sentence's label; some pairs of
sentences teach it where spans begin and end; sentences are chains of their own. Evidence of a token: its word, its first
letters, the words beside it, whether the word is rare (found in few of all documents, equal texts counted once), and whether
persons are addressed or named near it (personal pronouns, words for people), alone and together with a rare word.

A bounded sample of the corpus's texts stands beside the labelled sentences as unlabelled: its sentences are O at first. Chains
of the other folds then judge every labelled and unlabelled sentence: single labels clearly contradicted are left out, unlabelled
sentences clearly toxic are adopted (their tokens from DOUBT on as T, the others as O: a sentence may run on into an innocent one),
doubtful ones left out, and those hardest to tell are added as O. How often a sentence stands in the corpus plays no part.

Forward-backward marginals give spans with offsets in the original text. A document's score is that of its strongest span;
without a span the greatest marginal of its tokens, below THRESHOLD.

Texts are read as typesetting markup: macros defined in the text are expanded where used, comments and disabled parts are
text like any other, commands and braces are taken off. Disguised spelling is undone: spaced or dotted letters, figures for
letters, starred letters (by the known words that fit), drawn-out letters, discretionary hyphens, braces within words.

Every sentence of every document goes through the chain: the tokens of a slice of texts are integers in numpy arrays, and one
step of the recursion takes the tokens at the same position of all its sentences.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows used for training at most (by hash of the text); the sample table is far smaller.
MAX_LABELLED = 20_000
#: Distinct texts sampled (by hash of the text) for unlabelled sentences.
BACKGROUND = 2_000
#: A word is usual if at least this share of the distinct texts has it.
USUAL = 0.006
#: Words counted in memory before the counts are handed on.
HELD = 200_000
#: Pairs of sentences joined without a mark, from which the chain learns where spans begin and end.
JOINED = 300
#: Unlabelled sentences taken as O in training, and a quarter as many of one or two words.
HARMLESS = 4_000
#: Parts of the sentences, each judged by a chain of the others.
FOLDS = 3
#: Unlabelled sentences are adopted as T from this mean P(T), and left out from this one.
ADOPT, DOUBT = 0.7, 0.25
#: Tokens belong to a span if P(T) is at least this, and a document counts if its score is. Sentences are offending seldom,
#: but missed ones weigh as much as false ones.
THRESHOLD = 0.3
#: Tokens to either side in which persons count as near.
NEAR = 7
#: Personal and possessive pronouns that address or name a single person (I only as a capital), by language.
PERSONS = frozenset(
    "I me my mine you your yours he him his she her hers someone nobody whoever anyone everybody "
    "ich mich mir mein meine meinem meinen meiner du dich dir dein deine deinem deinen deiner er ihn ihm ihr ihre jemand niemand "
    "je moi mon ma mes tu te toi ton ta tes lui elle yo mí mi mis tú ti tus él ella contigo conmigo alguien nadie "
    "io mio mia miei tuo tua tuoi lei qualcuno nessuno jij jou jouw mij mijn hij hem zij haar iemand eu meu minha você teu tua seu sua ele ela "
    "я меня мне мой моя ты тебя тебе твой твоя вы вас вам ваш ваша он его ему она её ей".split()
)
#: Words for people and for groups of people.
PEOPLE = frozenset(
    "person people woman women man men girl girls boy boys guy guys refugees foreigners immigrants migrants "
    "frau frauen mann männer leute menschen ausländer flüchtlinge femme femmes homme hommes gens étrangers réfugiés immigrés "
    "mujer mujeres hombre hombres gente extranjeros refugiados inmigrantes donna donne uomo uomini stranieri rifugiati immigrati "
    "vrouw vrouwen mannen mensen buitenlanders vluchtelingen mulher mulheres homem homens pessoas estrangeiros imigrantes "
    "женщина женщины мужчина мужчины люди иностранцы беженцы мигранты".split()
)
#: Figures and marks written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})

#: Marks between sentences.
STOPS = (".", "!", "?", ";", "{", "}", "\n")

_MACRO = re.compile(r"\\(?:def|(?:re|provide)?(?:new)?command\*?)\s*\{?\\([A-Za-z]+)\}?(?:\[\d\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
_COMMAND = re.compile(r"\\(?:[A-Za-z]+\*?|[^A-Za-z-])")
_HYPHEN = re.compile(r"\\-")
_GLUE = re.compile(r"[{}](?<=\w[{}])(?=\w)")
_DOTTED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][.·_-]){2,}[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)")
_MAYBE_DOTTED, _MAYBE_SPACED = re.compile(r"[.·_-]\w[.·_-]\w"), re.compile(r" \w \w\b")
_TOKEN = re.compile(r"[^\W_][\w*@$]*|[.!?;{}]|\n(?!%)")
_WORD = re.compile(r"[^\W_][\w*@$]*")
_STOP = re.compile(r"[.!?;{}]|\n(?!%)")
_LONG = re.compile(r"(.)\1{2,}")
_PLAIN = re.compile(r"[^\W\d_]+")
#: Tokens that go through the chain at once (with the rest of a text).
SLICE = 200_000


def clean(text: str) -> str:
    """The text without markup and without the disguises that span several tokens."""
    for need, pattern, new in _steps(text):
        if need is None or need.search(text):
            text = pattern.sub(new, text)
    return text


def _steps(text: str) -> list[tuple[re.Pattern | None, re.Pattern, object]]:
    """What is replaced in a text, in order, each where what it needs is there."""
    out = []
    if "\\" in text:
        for name, body in _MACRO.findall(text) if "command" in text or "\\def" in text else ():
            if re.search(r"[^\W\d_]{3}", _COMMAND.sub("", body)):
                out.append((None, re.compile(rf"\\{name}(?![A-Za-z])(?:\{{\}})?"), lambda m, b=body: " " + b))
        out += [(None, _COMMAND, " "), (None, _HYPHEN, "")]
    if "{" in text:
        out.append((None, _GLUE, ""))
    return [*out, (_MAYBE_DOTTED, _DOTTED, lambda m: re.sub(r"[.·_-]", "", m[0])), (_MAYBE_SPACED, _SPACED, lambda m: m[0].replace(" ", ""))]


def origin(text: str) -> list[tuple[int, int]]:
    """For each character of the cleaned text, where in `text` that stands which it came from."""
    flat, at = text, [(i, i + 1) for i in range(len(text))]
    for need, pattern, new in _steps(text):
        if need is not None and not need.search(flat):
            continue
        out, where, last = [], [], 0
        for m in pattern.finditer(flat):
            part = new(m) if callable(new) else new
            out += [flat[last : m.start()], part]
            where += at[last : m.start()]
            kept = [i for i in range(m.start(), m.end()) if flat[i] not in " .·_-"] if need else []
            where += [at[i] for i in kept] if len(kept) == len(part) else [(at[m.start()][0], at[m.end() - 1][1])] * len(part)
            last = m.end()
        flat, at = "".join(out) + flat[last:], where + at[last:]
    return at


class Words:
    """Normal forms of tokens, given the words of the labelled sentences."""

    def __init__(self, known: set[str], usual: set[str] = frozenset()):
        self.known, self.usual, self.cache = known, usual, {}
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(known):
            self.by_length.setdefault(len(w), []).append(w)

    def normal(self, token: str) -> str:
        w = self.cache.get(token)
        if w is None:
            if len(self.cache) > 1_000_000:
                self.cache.clear()
            w = self.cache[token] = token if token == "I" else self._normal(token.lower())
        return w

    def _normal(self, w: str) -> str:
        if w in self.known:
            return w
        if w in STOPS:
            return "."
        if "*" in w.strip("*"):
            shape = re.compile(re.escape(w).replace(r"\*", "[^\\W\\d_]"))
            fits = [k for k in self.by_length.get(len(w), []) if shape.fullmatch(k)]
            return fits[0] if fits else "****"
        w = w.strip("*")
        if any(c.isdigit() or c in "@$" for c in w) and any(c.isalpha() for c in w):
            plain = w.translate(LEET)
            if plain.isalpha() and (plain in self.known or sum(c.isalpha() for c in w) * 2 >= len(w)):
                w = plain
        if _LONG.search(w):
            for n in (1, 2):
                short = _LONG.sub(lambda m: m[1] * n, w)
                if short in self.known:
                    return short
            w = _LONG.sub(lambda m: m[1], w)
        return "0" if w.isdigit() else w


def near(words: list[str]) -> list[tuple[int, int]]:
    """How many persons and words for people stand within NEAR tokens of each token."""
    n = len(words)
    who, folk = [i for i in range(n) if words[i] in PERSONS], [i for i in range(n) if words[i] in PEOPLE]
    if not who and not folk:
        return [(0, 0)] * n
    return [(sum(abs(i - j) <= NEAR for j in who), sum(abs(i - j) <= NEAR for j in folk)) for i in range(n)]


def features(words: list[str], usual: set[str] = frozenset()) -> list[list[str]]:
    """Evidence of each token: word, first letters, neighbours, rarity, persons near."""
    out, last = [], len(words) - 1
    for i, (w, (who, folk)) in enumerate(zip(words, near(words))):
        f = [w, w[:5] + "~"] if len(w) > 3 else [w]
        if i:
            f.append(words[i - 1] + "|" + w)
        if i < last:
            f.append(w + "|" + words[i + 1])
        if who:
            f.append("@who")
            if who > 1:
                f.append("@whom")
        if folk:
            f.append("@folk")
        if w not in usual and rarely(w):
            f.append("~rare")
            if who:
                f.append("~rare@who")
            if folk:
                f.append("~rare@folk")
        out.append(f)
    return out


def rarely(w: str) -> bool:
    return len(w) > 2 and w.replace("*", "").isalpha() or w == "****"


class Rows(dict):
    """Numbers of tokens; what a number stands for is in the lists of `table`."""

    def __init__(self, table: Table, normal):  # noqa: ANN001
        self.table, self.normal = table, normal

    def __missing__(self, token: str) -> int:
        self[token] = n = self.table.add(self.normal(token))
        return n


class Table:
    """The evidence of words by number: number 0 is a mark between sentences."""

    def __init__(self, chain: Chain):
        self.weights, self.bias, self.usual = chain.weights, chain.bias, chain.words.usual
        pairs = sorted((f.split("|", 1), v) for f, v in chain.weights.items() if "|" in f)
        self.member = {w: i + 1 for i, w in enumerate(sorted({w for ab, _ in pairs for w in ab}))}
        self.span = len(self.member) + 1
        keys = np.array([self.member[a] * self.span + self.member[b] for (a, b), _ in pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.pair = keys[order], np.array([v for _, v in pairs] or [0.0])[order]
        self.base, self.kind, self.mate = [0.0], [0], [0]
        self.rows = Rows(self, chain.words.normal)
        self.plain = Rows(self, lambda w: w)
        for rows in (self.rows, self.plain):
            for s in STOPS:
                rows[s] = 0

    def add(self, w: str) -> int:
        get = self.weights.get
        self.base.append(self.bias + get(w, 0.0) + (get(w[:5] + "~", 0.0) if len(w) > 3 else 0.0))
        self.kind.append((w in PERSONS) + 2 * (w in PEOPLE) + 4 * (w not in self.usual and rarely(w)))
        self.mate.append(self.member.get(w, 0))
        return len(self.base) - 1


class Chain:
    """A trained chain: evidence weights (log-odds of T) and transition log-potentials."""

    def __init__(self, weights: dict[str, float], bias: float, step: list[list[float]], words: Words):
        self.weights, self.bias, self.step, self.words = weights, bias, step, words
        self.table = Table(self)

    def marginals(self, numbers: np.ndarray) -> np.ndarray:
        """P(T) of each token, given its number; 0 at the marks between sentences (number 0)."""
        table, get, total = self.table, self.weights.get, len(numbers)
        there = numbers > 0
        out = np.zeros(total)
        if not there.any():
            return out
        first = np.flatnonzero(there & ~np.concatenate([[False], there[:-1]]))
        lens = np.flatnonzero(there & ~np.concatenate([there[1:], [False]])) + 1 - first
        e = np.array(table.base)[numbers]
        kind, mate = np.array(table.kind, np.int8)[numbers], np.array(table.mate, np.int64)[numbers]
        rare = (kind & 4) > 0
        e += rare * get("~rare", 0.0)
        if (kind & 3).any():
            spot = np.arange(total)
            begin, end = np.zeros(total, np.int64), np.zeros(total, np.int64)
            begin[there], end[there] = np.repeat(first, lens), np.repeat(first + lens, lens)
            lo, hi = np.maximum(spot - NEAR, begin), np.minimum(spot + NEAR + 1, end)
            for bit, name, more in ((1, "@who", "@whom"), (2, "@folk", "")):
                sums = np.concatenate([[0], np.cumsum((kind & bit) > 0)])
                n = sums[hi] - sums[lo]
                e += (n > 0) * (get(name, 0.0) + rare * get("~rare" + name, 0.0)) + (n > 1) * get(more, 0.0)
        two = np.flatnonzero((mate[1:] > 0) & (mate[:-1] > 0))
        if len(two):
            key = mate[two] * table.span + mate[two + 1]
            spot = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
            known = table.keys[spot] == key
            two, v = two[known], table.pair[spot[known]]
            e[two] += v
            e[two + 1] += v
        e = np.exp(np.clip(e, -30, 30))
        (oo, ot), (to, tt) = np.exp(np.array(self.step)).tolist()
        order = np.argsort(-lens, kind="stable")
        first, lens = first[order], lens[order]
        live = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0]), side="right")
        ahead = np.ones(total)
        for t, n in enumerate(live.tolist()):  # odds of T by what stands before, with the token
            p = first[:n] + t
            ahead[p] = e[p] * ((ot + tt * last[:n]) / (oo + to * last[:n])) if t else e[p]
            last = ahead[p]
        back = np.ones(len(lens))
        for t in range(len(live) - 1, -1, -1):  # and by what stands after it
            n = int(live[t])
            p = first[:n] + t
            odds = ahead[p] * back[:n]
            out[p] = odds / (1 + odds)
            x = e[p] * back[:n]
            back[:n] = (to + tt * x) / (oo + ot * x)
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int, int]]]]:
        """For each text its score, and (score, first token, end) of its toxic spans by the numbers of tokens in the cleaned text."""
        out: list[tuple[float, list[tuple[float, int, int]]]] = []
        held: list[int] = []
        ends: list[int] = []
        for i, text in enumerate(texts):
            held += map(self.table.rows.__getitem__, _TOKEN.findall(clean(text)) if text else ())
            held.append(0)
            ends.append(len(held))
            if len(held) > SLICE or i + 1 == len(texts):
                p = self.marginals(np.array(held, np.int64))
                mark = np.concatenate([[True], np.array(held) == 0, [True]])
                lone = mark[:-2] & mark[2:]  # a word alone between marks is no passage: in markup it is an argument
                hot = np.concatenate([[False], (p >= THRESHOLD) & ~lone, [False]])
                runs: dict[int, list] = {}
                start, stop = np.flatnonzero(hot[1:] & ~hot[:-1]), np.flatnonzero(hot[:-1] & ~hot[1:])
                owner = np.searchsorted(ends, start, side="right")
                for a, b, k in zip(start.tolist(), stop.tolist(), owner.tolist()):
                    runs.setdefault(k, []).append((float(p[a:b].mean()), a, b))
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                most = np.maximum.reduceat(p, begin)
                for k, (a, m) in enumerate(zip(begin.tolist(), most.tolist())):
                    found = [(s, x - a, y - a) for s, x, y in runs.get(k, ())]
                    out.append((max((s for s, *_ in found), default=min(m, THRESHOLD - 1e-6)), found))
                held, ends = [], []
                if len(self.table.base) > 1_000_000:
                    self.table = Table(self)
        return out

    def spans(self, text: str | None) -> list[tuple[float, int, int, str]]:
        """(score, start, end, words) of the toxic spans; offsets are those in the text as it came."""
        return self.located([text])[0]

    def located(self, texts: list[str | None]) -> list[list[tuple[float, int, int, str]]]:
        """The spans of each text."""
        out = []
        for text, (_, found) in zip(texts, self.judge(texts)):
            if found:
                at, tokens = origin(text), list(_TOKEN.finditer(clean(text)))
                ends = [(s, at[tokens[a].start()][0], at[tokens[b - 1].end() - 1][1]) for s, a, b in found]
                found = [(s, a, b, text[a:b]) for s, a, b in ends]
            out.append(found)
        return out


def sentences(text: str) -> list[list[str]]:
    """The tokens of each sentence of a text in markup."""
    out: list[list[str]] = [[]]
    for t in _TOKEN.findall(clean(text)):
        if t in STOPS:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def often(n: int) -> int:
    """Of n distinct texts, how many a usual word stands in."""
    return max(2, round(USUAL * n))


def labelled(rows: list[tuple[str, int]]) -> tuple[dict[str, list[int]], set[str]]:
    """How often each labelled sentence, by its tokens, is called O and T, and the words of all."""
    votes: dict[str, list[int]] = {}
    for t, y in rows:
        votes.setdefault(" ".join(x for x in _TOKEN.findall(clean(t)) if x not in STOPS), [0, 0])[y] += 1
    votes.pop("", None)
    return votes, {t.lower() for k in votes for t in k.split(" ") if t.isalpha()}


def fit(rows: list[tuple[str, int]], background: list[str] = (), usual: set[str] | None = None, steps: int = 60) -> Chain:
    """Train on (text, label) and on unlabelled texts: penalised log-likelihood by gradient ascent over sentences. `usual` has
    the usual words of all documents; without it those of `background`."""
    called, known = labelled(rows)
    words = Words(known)
    said = [sentences(t) for t in sorted(set(background))]
    if usual is None:
        seen: dict[str, int] = {}
        for s in said:
            for w in {t.lower() for x in s for t in x}:
                seen[w] = seen.get(w, 0) + 1
        usual = {w for w, n in seen.items() if n >= often(len(said))}
    words.usual = usual
    votes: dict[str, list[int]] = {}
    for k, v in called.items():  # disguised and plain spellings are one sentence
        got = votes.setdefault(" ".join(words.normal(t) for t in k.split(" ")), [0, 0])
        got[0], got[1] = got[0] + v[0], got[1] + v[1]
    chain = Chain({}, -1.0, [[1.0, -2.0], [-2.0, 1.0]], words)
    if not votes:
        return chain
    crc = lambda k: zlib.crc32(k.encode())
    told = [(k.split(" "), int(b > a), abs(b - a), crc(k) % FOLDS) for k, (a, b) in sorted(votes.items())]
    keys = sorted({" ".join([words.normal(t) for t in s]) for x in said for s in x} - votes.keys(), key=lambda k: (crc(k), k))
    free = [(k.split(" "), i % FOLDS) for i, k in enumerate(keys)]
    full, short = [i for i, (s, _) in enumerate(free) if len(s) > 2], [i for i, (s, _) in enumerate(free) if len(s) < 3]
    taken = {*full[:HARMLESS], *short[: HARMLESS // 4]}
    number = lambda judge, s: np.fromiter(map(judge.table.plain.__getitem__, s), np.int64, len(s))
    kept, adopted, calm, hard = [], [], [], []
    first = [free[i] for i in sorted(taken)]
    light = min(6, max(1, HARMLESS // max(1, len(first))))  # few unlabelled sentences weigh as labelled ones
    for k in range(FOLDS):
        judge = _ascend([(s, y, 6) for s, y, d, f in told if f != k and d] + [(s, 0, light) for s, _ in first], words, k, steps - 20)
        for s, y, d, f in told:
            if f == k:
                p = float(np.mean(judge.marginals(number(judge, s))))
                if not d or d > 1 or abs(y - p) < 0.9:  # ties go by the judge, two votes more stand
                    kept.append((s, y if d else int(p > 0.5), 6))
    for k in range(FOLDS):
        judge = _ascend(kept + [(s, 0, light) for s, f in first if f != k], words, FOLDS + k, steps - 20)
        own = [i for i, (_, f) in enumerate(free) if f == k]
        p = judge.marginals(np.concatenate([np.append(number(judge, free[i][0]), 0) for i in own])) if own else np.zeros(0)
        at = np.concatenate([[0], np.cumsum([len(free[i][0]) + 1 for i in own])]).astype(int)
        for i, a, b in zip(own, at, at[1:]):
            s, mean = free[i][0], float(p[a : b - 1].mean())
            if mean >= ADOPT and len(s) > 2:
                adopted.append((s, (p[a : b - 1] >= DOUBT).astype(int).tolist(), 2))
            elif mean < DOUBT:
                if i in taken:
                    calm.append((s, 0, light))
                elif p[a:b].max() >= 0.1:
                    hard.append((s, 0, 1))
    return _ascend(kept + adopted + calm + hard, words, 2 * FOLDS, steps)


def _ascend(pool: list[tuple[list[str], int | list[int], int]], words: Words, seed: int, steps: int) -> Chain:
    """The chain of sentences, each with its label (or those of its tokens) and weight. Tokens lie one after the other, longest
    sentence first, so that the sentences that reach position t are the first ones."""
    rng = np.random.default_rng(seed)
    flat = [(s, y if isinstance(y, list) else [y] * len(s), float(n)) for s, y, n in pool]
    heavy, share = [x for x in flat if x[2] > 1], np.array([x[2] for x in pool], float)
    for i, k in zip(rng.integers(len(heavy), size=JOINED), rng.choice(len(pool), JOINED, p=share / share.sum())):  # two without a mark in between
        parts = [heavy[i], flat[k]][:: 1 if rng.random() < 0.5 else -1]
        flat.append(([x for s, *_ in parts for x in s], [v for _, lab, _ in parts for v in lab], 1.0))
    flat.sort(key=lambda x: -len(x[0]))
    lens = np.array([len(x[0]) for x in flat])
    start, total = np.concatenate([[0], np.cumsum(lens)[:-1]]), int(lens.sum())
    at = [start[: int((lens > t).sum())] + t for t in range(lens[0])]
    index: dict[str, int] = {}
    got = [[index.setdefault(x, len(index)) for x in f] for s, *_ in flat for f in features(s, words.usual)]
    rr, cc = np.repeat(np.arange(total), [len(g) for g in got]), np.array([x for g in got for x in g])
    y, often = np.array([v for _, lab, _ in flat for v in lab]), np.repeat([n for *_, n in flat], lens)
    ridge = np.array([0.1 if f[0] in "~@" else 4.0 if "|" in f else 0.5 for f in index])
    size = len(index)
    w, b, a = np.zeros(size), -0.5, np.array([[1.0, -1.0], [-1.0, 1.0]])
    m, v = np.zeros(size + 5), np.zeros(size + 5)
    pair = np.zeros((2, 2))
    for p in at[1:]:
        np.add.at(pair, (y[p - 1], y[p]), often[p])
    for k in range(1, steps + 1):
        ex, step = np.exp(np.clip(np.bincount(rr, w[cc], total) + b, -30, 30)), np.exp(a)
        fwd, bwd, c, joint = np.empty((total, 2)), np.ones((total, 2)), np.empty(total), np.zeros((2, 2))
        for t, p in enumerate(at):
            x = fwd[p - 1] @ step if t else np.ones((len(p), 2))
            x[:, 1] *= ex[p]
            c[p] = x.sum(1)
            fwd[p] = x / c[p, None]
        for p in at[:0:-1]:
            g = bwd[p] / c[p, None]
            g[:, 1] *= ex[p]
            j = fwd[p - 1][:, :, None] * step * g[:, None, :]
            joint += (j * (often[p] / j.sum((1, 2)))[:, None, None]).sum(0)
            bwd[p - 1] = g @ step.T
        toxic = fwd[:, 1] * bwd[:, 1] / (fwd * bwd).sum(1)
        d, g = (y - toxic) * often, np.zeros(size + 5)
        g[:size] = np.bincount(cc, d[rr], size) - ridge * w
        g[size] = d.sum() - b
        g[size + 1 :] = (pair - joint).ravel() - a.ravel()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        up = 0.12 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        w, b, a = w + up[:size], b + up[size], a + up[size + 1 :].reshape(2, 2)
    return Chain({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 0.01}, float(b), a.tolist(), words)


def count(docs: DataFrame) -> tuple[int, set[str]]:
    """The number of distinct texts and their usual words: all documents are counted, equal texts once. Batches are counted
    where they are and summed by word."""
    texts = docs.where("text is not null and text <> ''").select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*seen, ""]), pa.array([*seen.values(), n], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                seen.update(set(_PLAIN.findall(t.lower())))
                if len(seen) > HELD:
                    yield told()
                    seen, n = Counter(), 0
        yield told()

    sums = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).persist()
    try:
        n = sums.where("word = ''").first().n
        return n, {r.word for r in sums.where((F.col("word") != "") & (F.col("n") >= often(n))).select("word").collect()}
    finally:
        sums.unpersist()


def train(docs: DataFrame, sample: DataFrame) -> Chain:
    """The chain from a table of labelled sentences (text, label), from the counts over all documents and from about BACKGROUND
    distinct texts; unlabelled and empty sentences are left out, and at most MAX_LABELLED are used."""
    rows = sample.where("label is not null and text is not null and text <> ''").select("text", "label").orderBy(F.xxhash64("text"), "text", "label").limit(MAX_LABELLED).collect()
    rows = [(r.text, int(r.label > 0)) for r in rows]
    n, usual = count(docs)
    calm = docs.where("text is not null and text <> ''")
    if n > BACKGROUND:
        calm = calm.where(F.xxhash64("text") < F.lit(int(BACKGROUND / n * 2**64) - 2**63))
    return fit(rows, [r.text for r in calm.select("text").distinct().collect()], usual)


def score(docs: DataFrame, sample: DataFrame, spans: bool = False) -> DataFrame:
    """doc_id, source, score for every document (null and empty texts 0), or with `spans`, doc_id, start,
    stop, span, score for each offending span. Repeated rows each count; extra columns are ignored."""
    chain = train(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((chain.weights, chain.bias, chain.step, chain.words.known, chain.words.usual))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, step, known, usual = shared.value
        own = Chain(weights, bias, step, Words(known, usual))
        for b in batches:
            if spans:
                found = own.located(b.column(2).to_pylist())
                rows = [(i, *s) for i, f in enumerate(found) for s in f]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                    ["doc_id", "start", "stop", "span", "score"],
                )
            else:
                best = pa.array([s for s, _ in own.judge(b.column(2).to_pylist())], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), best], ["doc_id", "source", "score"])

    schema = "doc_id bigint, start int, stop int, span string, score double" if spans else "doc_id bigint, source string, score double"
    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


def found(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id of each document with a toxic passage."""
    return score(docs, sample).where(F.col("score") >= THRESHOLD).select("doc_id")


def source_name(source):  # noqa: ANN001, ANN201
    """One spelling of a source: lower case, outer blanks cut, - as _."""
    return F.translate(F.lower(F.trim(source)), "- ", "__")


def rates(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """source, docs, toxic, rate: by source, spellings made one; a null source is a source of its own."""
    s = score(docs, sample).select(source_name(F.col("source")).alias("source"), (F.col("score") >= THRESHOLD).cast("bigint").alias("hit"))
    return s.groupBy("source").agg(F.count("*").alias("docs"), F.sum("hit").alias("toxic"), F.avg("hit").alias("rate"))
