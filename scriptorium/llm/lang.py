"""Languages of scans and of passages by interpolated Kneser-Ney character models.

Each language has a character model of order ORDER. The models of all languages lie in one sorted array of n-gram hashes with
a column per language for the discounted probability of the n-gram and for the weight of the lower order after it as context,
so a text is scored by binary search, all positions at once. A sentence gets the language of the lowest length-normalised
cross-entropy. It is rejected if its lead over the next language, calibrated on held-out sentences, is too small.

Only words that begin in lower case and the sentence's first word are scored: names, addresses, numbers and codes say nothing
about the language around them. The models are fitted on SAMPLE text blocks (by hash of the id) under their scans' labels;
as labels can be wrong, sentences whose words belong to another language are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.sampling import by_hash

LANGS = ("en", "de", "fr", "es", "it", "nl", "pt", "ru")
ORDER = 5
#: Text blocks used for fitting, and characters of each language at most.
SAMPLE, MAX_CHARS = 12_000, 80_000
#: A training sentence's words must speak for its label by this lead (nats).
CLEAR = 5.0
#: Held-out accuracy that accepted sentences must reach.
PRECISION = 0.995
#: A foreign passage's lead must be at least that of this share of the held-out sentences, and its entropy about theirs: a wrong one is a wrong row, while
#: for a scan's main language the sum over its sentences decides.
PASSAGE = 0.99
#: A sentence needs so many scored words and letters.
MIN_WORDS, MIN_LETTERS = 3, 10

#: Names and codes of the languages (a region after - or _ is cut first).
LABELS = {
    "en": "en eng english englisch anglais inglés ingles inglese engels inglês английский",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco duits alemão alemao немецкий",
    "fr": "fr fra fre french français francais französisch franzosisch francés frances francese frans francês французский",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo spaans espanhol испанский",
    "it": "it ita italian italiano italienisch italien italiaans итальянский",
    "nl": "nl nld dut dutch nederlands niederländisch niederlandisch néerlandais neerlandais neerlandés holandés olandese holandês neerlandês нидерландский голландский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese portugees португальский",
    "ru": "ru rus russian русский russisch russe ruso russo",
}

_ADDRESS = re.compile(r"\S+ ?(?:@|\[at\]|\(at\)) ?\S+(?:\s?(?:\.|\[dot\])\s?[\w-]+)*")
_CYRILLIC = re.compile("[а-яё]")
_END = re.compile(r"(?<=[.!?])[\"'»”)]*\s+(?=[^\W\d_a-zß-öø-ÿа-я]|[¿¡\"«(])")
_CUT = re.compile(r"(?<=[^\W\d_])[-‐¬\xad][ \t]*\n(?=[^\W\d_])")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"(?<![\w@./+-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@/]|\.\w)")


def label_code(label):  # noqa: ANN001, ANN201
    """The code of a label, null if it names none of the languages."""
    import json

    codes = F.from_json(F.lit(json.dumps({w: k for k, ws in LABELS.items() for w in ws.split()})), "map<string,string>")
    plain = F.lower(F.trim(label))
    return F.coalesce(codes[plain], codes[F.substring_index(F.substring_index(plain, "-", 1), "_", 1)], codes[F.substring_index(plain, " ", 1)])


def sentences(text: str | None) -> list[tuple[str, bool]]:
    """(sentence, whether it has an end) of a text, lines joined."""
    if not text:
        return []
    flat = re.sub(r"\s+", " ", _CUT.sub("", text)).strip()
    return [(s, s.rstrip("\"'»”)")[-1:] in (".", "!", "?")) for s in _END.split(flat) if s]


def scored(sentence: str) -> tuple[str, int]:
    """The scored words of a sentence as ' a b c ', and their number."""
    words = _WORD.findall(_ADDRESS.sub(" ", sentence) if "@" in sentence or "at]" in sentence or "(at)" in sentence else sentence)
    kept = [w.lower() for i, w in enumerate(words) if i == 0 or w[0].islower()]
    return f" {' '.join(kept)} ", sum(1 for i, w in enumerate(words) if w[0].islower() and len(w) > 1)


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of each window of `order` codes."""
    if len(codes) < order:
        return np.zeros(0, np.uint64)
    h = np.full(len(codes) - order + 1, order, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ codes[k : len(codes) - order + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Models:
    """The languages' models in one sorted array."""

    def __init__(self, keys: np.ndarray, gram: np.ndarray, back: np.ndarray, floor: float, lead: float = 0.0, slope: float = 1.0, passage: float = 0.0, most: float = 99.0):
        self.keys, self.gram, self.back, self.floor, self.lead, self.slope, self.passage, self.most = keys, gram, back, floor, lead, slope, passage, most
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((0, len(LANGS)))

    @staticmethod
    def fit(texts: dict[str, list[str]], discount: float = 0.75) -> Models:
        """Interpolated Kneser-Ney: raw counts at the highest order, numbers of different predecessors below."""
        gram: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
        back: dict[int, np.ndarray] = defaultdict(lambda: np.ones(len(LANGS)))
        alphabet = {c for ts in texts.values() for t in ts for c in t}
        hashed = lambda g: int(_hashes(_codes(g), len(g))[0])
        for lang, ts in texts.items():
            col = LANGS.index(lang)
            grams = [Counter() for _ in range(ORDER + 1)]
            for t in ts:
                for n in range(1, ORDER + 1):
                    grams[n].update(t[i : i + n] for i in range(len(t) - n + 1))
            for n in range(1, ORDER + 1):
                counts = grams[n] if n == ORDER else Counter(g[1:] for g in grams[n + 1])
                total, kinds = Counter(), Counter()
                for g, c in counts.items():
                    total[g[:-1]] += c
                    kinds[g[:-1]] += 1
                for g, c in counts.items():
                    gram[hashed(g)][col] = max(c - discount, 0) / total[g[:-1]]
                for h, t in total.items():
                    if h:
                        back[hashed(h)][col] = discount * kinds[h] / t
                    else:
                        back[0][col] = discount * kinds[h] / t
        keys = np.array(sorted({*gram, *back}), np.uint64)
        none, one = np.zeros(len(LANGS)), np.ones(len(LANGS))
        table = lambda d, e: np.array([d.get(int(k), e) for k in keys]).reshape(len(keys), len(LANGS)).astype(np.float32)
        return Models(keys, table(gram, none), table(back, one), 1.0 / max(1, 4 * len(alphabet)))

    def _at(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where there is none."""
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, i, -1)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Negative log-probability of each character given the ones before it, under each language; line ends have none."""
        zero = self._at(np.zeros(1, np.uint64))[0]
        p = np.full((len(codes), len(LANGS)), self.floor, np.float32)
        if zero >= 0:
            p *= self.back[zero]
        context = None
        for n in range(1, ORDER + 1):
            rows = self._at(_hashes(codes, n))
            if n > 1:  # rows of the (n-1)-grams that begin where the n-grams begin
                c = np.flatnonzero(context[: len(rows)] >= 0)
                p[c + n - 1] *= self.back[context[c]]
            r = np.flatnonzero(rows >= 0)
            p[r + n - 1] += self.gram[rows[r]]
            context = rows
        logs = -np.log(np.maximum(p, 1e-9))
        logs[np.flatnonzero(codes == 10)] = 0
        return logs

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character (nats) of each text ' a b c ' under each language.

        A character depends on the ORDER - 1 before it, so a word's sum depends on the last ones before the word only. These
        sums are kept by (what stands before, word): words follow Zipf's law, sentences do not.
        """
        if not len(self.keys) or not texts:
            return np.zeros((len(texts), len(LANGS)))
        if len(self.rows) > 500_000:
            self.rows, self.sums = {}, np.zeros((0, len(LANGS)))
        rows, keys, count = self.rows, [], []
        for t in texts:
            before, words = "\n ", t.split()
            count.append(max(1, len(words)))
            for w in words or [""]:
                keys.append(before + w)
                before = (before + w + " ")[1 - ORDER :]
        new = [k for k in dict.fromkeys(keys) if k not in rows]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            codes = _codes("\n".join(k + " " if k != "\n " else k for k in part))
            ends = np.cumsum([len(k) + (k != "\n ") + 1 for k in part])
            size = np.array([len(k) - k.rfind(" ") - 1 + (k != "\n ") + (k[0] == "\n" and k.rfind(" ") == 1) for k in part])  # the word, its blank, and a text's first blank
            total = np.concatenate([np.zeros((1, len(LANGS))), np.cumsum(self.logs(codes), axis=0, dtype=np.float64)])
            at = len(rows)
            rows.update(zip(part, range(at, at + len(part))))
            self.sums = np.concatenate([self.sums, total[ends - 1] - total[ends - 1 - size]])
        ids = np.fromiter(map(rows.__getitem__, keys), np.int64, len(keys))
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        return np.add.reduceat(self.sums[ids], start, axis=0) / np.array([max(1, len(t)) for t in texts])[:, None]

    def languages(self, texts: list[str]) -> list[tuple[str | None, bool, float]]:
        """(language or None if rejected, whether it is sure enough for a foreign passage, confidence) of each text's words."""
        if not texts:
            return []
        e = self.entropies(texts)
        best = e.argmin(1)
        least, second = np.partition(e, 1, axis=1)[:, :2].T
        lead = second - least
        conf = 1 / (1 + np.exp(-self.slope * lead * np.array([len(t) for t in texts])))
        sure = (lead >= self.passage) & (least <= self.most)
        return [(LANGS[b] if x else None, s, c) for b, x, s, c in zip(best.tolist(), (lead >= self.lead).tolist(), sure.tolist(), conf.tolist())]

    def calibrate(self, held: list[tuple[str, str]]) -> None:
        """The least lead at which accepted held-out sentences are right often enough, and the confidence's slope."""
        rows = []
        for (text, lang), e in zip(held, self.entropies([t for t, _ in held])):
            o = np.argsort(e, kind="stable")
            rows.append((float(e[o[1]] - e[o[0]]), LANGS[o[0]] == lang, len(text), float(e[o[0]])))
        rows.sort(reverse=True)
        self.passage = rows[int(PASSAGE * (len(rows) - 1))][0] if rows else 0.0
        self.most = 1.25 * sorted(r[3] for r in rows)[int(0.98 * (len(rows) - 1))] if rows else 99.0
        right, self.lead = 0, rows[0][0] if rows else 0.0
        for i, (lead, ok, *_) in enumerate(rows, 1):
            right += ok
            if right >= PRECISION * i:
                self.lead = lead
        x = np.array([r[0] * r[2] for r in rows])
        y = np.array([r[1] for r in rows], float)
        if len(rows):
            grid = np.array([0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0])
            loss = [-(y * np.log(1e-9 + 1 / (1 + np.exp(-s * x))) + (1 - y) * np.log(1e-9 + 1 - 1 / (1 + np.exp(-s * x)))).sum() for s in grid]
            self.slope = float(grid[int(np.argmin(loss))])


def fit(labelled: list[tuple[str, str]]) -> Models:
    """Models from (language, text): fitted on the sentences whose words belong to the label's language, nine tenths of
    them, and calibrated on the rest.

    A word belongs to the languages under whose label it is frequent; wrong labels bring foreign words into a language only
    at their share, so over a sentence's words the right language leads clearly.
    """
    rows = [(lang, s) for lang, t in labelled for x, _ in sentences(t) for s, n in [scored(x)] if n >= MIN_WORDS]
    count, total = defaultdict(Counter), Counter()
    for lang, s in rows:
        words = s.split()
        count[lang].update(words)
        total[lang] += len(words)

    names, kept = sorted(total), {}

    def speaks(w: str) -> np.ndarray:
        if w not in kept:
            kept[w] = np.log(np.array([(count[k][w] + 0.1) / (total[k] + 100) for k in names]))
        return kept[w]

    def clear(lang: str, s: str) -> bool:
        if bool(_CYRILLIC.search(s)) != (lang == "ru"):
            return False
        score = sorted(zip(sum(speaks(w) for w in s.split()), names), reverse=True)
        return score[0][1] == lang and (len(score) == 1 or score[0][0] - score[1][0] >= CLEAR)

    agreed = sorted({(lang, s) for lang, s in rows}, key=lambda r: zlib.crc32(r[1].encode()))[: 40 * MAX_CHARS // 60]
    agreed = [(lang, s) for lang, s in agreed if clear(lang, s)]
    texts: dict[str, list[str]] = defaultdict(list)
    held, size = [], Counter()
    for lang, s in agreed:
        if zlib.crc32(s.encode()[::-1]) % 10 == 0:
            held.append((s, lang))
        elif size[lang] < MAX_CHARS:
            texts[lang].append(s)
            size[lang] += len(s)
    models = Models.fit(texts)
    models.calibrate(held[:4000])
    return models


def train(scan: DataFrame, block: DataFrame) -> Models:
    """Models fitted on SAMPLE texts of scans whose label names a language."""
    known = scan.select("scan_id", label_code(F.col("language")).alias("lang")).where("lang is not null")
    text = by_hash(block.where("text is not null").select("scan_id", "block_id", "text"), SAMPLE, "block_id")
    rows = sorted(text.join(known, "scan_id").select("lang", "text").collect())
    return fit([(r.lang, r.text) for r in rows])


def passages(scan: DataFrame, block: DataFrame) -> DataFrame:
    """scan_id, block_id, lang, letters, whole, confidence: for each block and language its sentences have, their letters,
    the number of whole sentences and their mean confidence. Rejected sentences count for no language."""
    models = train(scan, block)
    shared = block.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Models = shared.value
        for b in batches:
            said, words = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                for s, whole in sentences(t):
                    w, n = scored(s)
                    if n >= MIN_WORDS and len(w) >= MIN_LETTERS:
                        said.append((i, s, whole))
                        words.append(w)
            judged = iter(own.languages(words))
            out: list[tuple] = []
            scans, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, xs in groupby(said, lambda x: x[0]):
                scan_id, block_id, sums = scans[i], blocks[i], {}
                for _, s, whole in xs:
                    lang, sure, conf = next(judged)
                    if lang is not None:
                        x = sums.setdefault(lang, [0, 0, 0.0, 0])
                        x[0] += sum(map(len, _LETTERS.findall(s)))
                        x[1] += whole and sure
                        x[2] += conf
                        x[3] += 1
                out += [(scan_id, block_id, lang, x[0], x[1], x[2] / x[3]) for lang, x in sums.items()]
            cols = list(zip(*out)) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["scan_id", "block_id", "lang", "letters", "whole", "confidence"])

    texts = block.where("text is not null and text <> '' and scan_id is not null").select("scan_id", "block_id", "text")
    return texts.mapInArrow(run, "scan_id bigint, block_id bigint, lang string, letters bigint, whole int, confidence double")


def main_language(parts: DataFrame) -> DataFrame:
    """scan_id, main, confidence: the language of most letters (ties: first by code), confidence weighted by letters. A scan
    is first summed by language, so no scan is gathered."""
    by = parts.groupBy("scan_id", "lang").agg(F.sum("letters").alias("letters"), F.sum(F.col("confidence") * F.col("letters")).alias("c"))
    rank = F.struct(F.col("letters"), F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))
    return by.groupBy("scan_id").agg(F.max_by("lang", rank).alias("main"), (F.max_by("c", rank) / F.sum("letters")).alias("confidence"))


def find(scan: DataFrame, block: DataFrame) -> DataFrame:
    """scan_id, block_id, lang: with block_id 0 each scan with running text whose label is not its main language (lang: the
    main one); with a block_id each language other than the main one in which the block has a whole sentence.

    Null and empty texts say nothing; scans without a sentence give no row; a label that names no language counts as
    missing. Repeated scans give repeated rows for block_id 0 only once per scan_id. Extra columns are ignored.
    """
    from scriptorium.session import checkpoint

    parts = checkpoint(passages(scan, block))
    main = main_language(parts).select("scan_id", "main")
    label = scan.where("scan_id is not null").groupBy("scan_id").agg(F.max(label_code(F.col("language"))).alias("label"))
    scans = main.join(label, "scan_id").where("label is null or label <> main").select("scan_id", F.lit(0).cast("bigint").alias("block_id"), F.col("main").alias("lang"))
    blocks = parts.where("whole > 0").join(main, "scan_id").where("lang <> main").select("scan_id", "block_id", "lang").distinct()
    return scans.unionByName(blocks)


def labels(scan: DataFrame, block: DataFrame) -> DataFrame:
    """scan_id, block_id, lang, confidence: the main language of each scan (block_id 0) and of each foreign passage."""
    from scriptorium.session import checkpoint

    parts = checkpoint(passages(scan, block))
    main = main_language(parts)
    blocks = parts.where("whole > 0").join(main.select("scan_id", "main"), "scan_id").where("lang <> main").select("scan_id", "block_id", "lang", "confidence")
    return main.select("scan_id", F.lit(0).cast("bigint").alias("block_id"), F.col("main").alias("lang"), "confidence").unionByName(blocks)
