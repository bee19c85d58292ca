"""Subject areas of documents by class-association rules."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.functions.text import normal_form
from jsonloom.llm.mail import own_paragraphs
from jsonloom.session import stage

#: Bound of the labelled documents that the rules are fitted on; more are sampled by a hash of their ids. The
#: unlabelled ones, whose clear paragraphs are added, count whole, and scoring covers every document.
LABELLED = 20_000
#: Distinct words that a task counts before it hands the counts on.
HELD = 200_000
LONGEST_SENTENCE = 60  # words of a transaction; a longer sentence gives several
LONGEST_RULE = 3  # words of a rule
SUPPORT = 2e-6  # least share of all units that a word of a rule is in; of a rule on several words, 50 times that
COMMON = 0.2  # a word of all subjects: in more than this share of the units
GROUPS = 64  # of words, each mined by itself
STRICT = 3.3  # deviations that a rule on several words is lowered by; far more of them are tried
UNCLEAR = 0.5  # what a paragraph that no rule places yet weighs against a word

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
Paragraphs = Callable[[str | None], list[str]]


def sentences(paragraph: str) -> list[list[str]]:
    """The words of each sentence, in lower case."""
    return [w for w in (_WORD.findall(s) for s in _SENTENCE.split(paragraph.lower())) if w]


def packed(paragraph: str) -> str:
    """A paragraph's sentences as text: a line each, words parted by blanks."""
    return "\n".join(" ".join(w) for w in sentences(paragraph))


def unpacked(lines: str) -> list[list[str]]:
    return [s.split(" ") for s in lines.split("\n")] if lines else []


@dataclass
class Rules:
    """Pruned class-association rules: a set of words, the area it speaks for, and its calibrated confidence."""

    rules: list[tuple[tuple[str, ...], str, float]]
    units: int = 0  # labelled documents and paragraphs with an area that they were mined from
    _alone: dict[str, tuple[float, str]] = field(default_factory=dict, repr=False)
    _together: dict[str, list[tuple[frozenset[str], float, str]]] = field(default_factory=dict, repr=False)
    _lines: dict[str, tuple[str, float] | None] = field(default_factory=dict, repr=False)

    def _index(self) -> None:
        for words, area, p in self.rules:
            if len(words) == 1:
                self._alone[words[0]] = max((p, area), self._alone.get(words[0], (0.0, "")))
            else:
                self._together.setdefault(words[0], []).append((frozenset(words), p, area))

    def sentence(self, words: Sequence[str]) -> tuple[str, float] | None:
        """The area a sentence speaks for, by its strongest matching rule, and that rule's confidence."""
        if not self._alone and not self._together:
            self._index()
        best = max((self._alone[w] for w in words if w in self._alone), default=(0.0, ""))
        if self._together:
            every = set(words)
            for w in every & self._together.keys():
                for said, p, area in self._together[w]:
                    if (p, area) > best and said <= every:
                        best = (p, area)
        return (best[1], best[0]) if best[1] else None

    def line(self, text: str) -> tuple[str, float] | None:
        """``sentence`` of a line of ``packed``; set phrases are looked up once."""
        if text in self._lines:
            return self._lines[text]
        if len(self._lines) >= HELD:
            self._lines.clear()
        found = self._lines[text] = self.sentence(text.split(" "))
        return found

    def paragraph(self, lines: str) -> tuple[dict[str, float], dict[str, int]]:
        """(evidence, sentences) by area, of a paragraph ``packed``."""
        score: dict[str, float] = {}
        count: dict[str, int] = {}
        for line in lines.split("\n"):
            if v := self.line(line):
                score[v[0]] = score.get(v[0], 0.0) + v[1]
                count[v[0]] = count.get(v[0], 0) + 1
        return score, count

    def area(self, text: str, least: int = 2, share: float = 0.6) -> tuple[str, float] | None:
        """The area a paragraph is devoted to, if one has at least ``least`` sentences and ``share`` of all evidence."""
        return self.placed(packed(text), least, share)

    def placed(self, lines: str, least: int = 2, share: float = 0.6) -> tuple[str, float] | None:
        """The same of a paragraph ``packed``."""
        score, count = self.paragraph(lines)
        if not score:
            return None
        top = max(score, key=lambda a: (score[a], a))
        if count[top] >= least and score[top] >= share * sum(score.values()):
            return top, score[top]
        return None

    def write(self, spark: SparkSession, path: str) -> None:
        """Rules as a Parquet table (words, area, confidence), so that they are fitted once and used again."""
        spark.createDataFrame([(list(w), a, p) for w, a, p in self.rules], "words array<string>, area string, confidence double").write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Rules:
        return Rules([(tuple(r.words), r.area, r.confidence) for r in spark.read.parquet(path).collect()])


def _wilson(hits, n, z: float, sqrt: Callable = math.sqrt):
    """Lower bound of a proportion; of Columns with their ``sqrt``."""
    p, z2 = hits / n, z * z
    return (p + z2 / (2 * n) - z * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_READ = "doc_id bigint, areas array<string>, paragraphs array<string>"
Rows = Iterable[tuple[tuple[str, ...], str, int]]


def _reader(read: Paragraphs) -> Mapper:
    """(doc_id, areas, paragraphs) of documents with (doc_id, areas, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[q for p in read(t) if (q := packed(p))] for t in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1).cast(pa.list_(pa.string())), pa.array(own, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "areas", "paragraphs"])

    return run


def _said(areas: list[str], paragraphs: list[str], rules: Rules | None) -> Iterator[tuple[list[str], list[list[str]]]]:
    """The units of a document: all of a labelled one; each paragraph of an unlabelled one, with the area in
    which the rules place it clearly, if any."""
    if areas:
        yield areas, [s for p in paragraphs for s in unpacked(p)]
    elif rules is not None:
        for p in paragraphs:
            if "\n" in p:
                a = rules.placed(p, 2, 0.75)
                yield [a[0]] if a else [], unpacked(p)


def _counter(rules: Rules | None) -> Mapper:
    """(word, area, hits, said): in how many units of the area a word is, and in how many of their sentences;
    combined within the task. Area '' stands for units without one. A unit of k areas counts k - 1 times under
    '+' too. Word '=' stands for the units themselves."""

    def counted(hits: dict[str, Counter[str]], said: dict[str, Counter[str]]) -> pa.RecordBatch:
        rows = [(w, a, n, said[a][w]) for a, of in hits.items() for w, n in of.items()]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["word", "area", "hits", "said"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[str, Counter[str]] = defaultdict(Counter)
        said: dict[str, Counter[str]] = defaultdict(Counter)
        for b in batches:
            for labels, paragraphs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for areas, sents in _said(labels, paragraphs, rules):
                    each = [w for s in sents for w in set(s)]
                    own = {"=", *each}
                    for a in [*(areas or [""]), *["+"] * (len(areas) - 1)]:
                        hits[a].update(own)
                        said[a].update(each)
            if sum(map(len, hits.values())) >= HELD:
                yield counted(hits, said)
                hits, said = defaultdict(Counter), defaultdict(Counter)
        yield counted(hits, said)

    return run


@dataclass
class _Counts:
    """What is known of the words of all units: rules on one word, and words that may speak together."""

    rules: dict[tuple[str, ...], tuple[str, float]]
    open: dict[str, int]  # word -> rank, the most frequent first
    bounds: dict[str, float]  # what the confidence of a rule must reach, by area
    frequent: int  # how many sentences of an area a pattern needs
    placed: int


def _count_words(units: DataFrame, rules: Rules | None, least: int, said: int, z: float) -> _Counts:
    """Words that speak for an area: their units have it in common far more often than its own share would
    give, by the lower bound of what their number supports. Words that don't, and are no words of all
    subjects, may still speak for one together with others, if a rule on them could beat their own."""
    counts = units.select("areas", "paragraphs").mapInArrow(_counter(rules), "word string, area string, hits bigint, said bigint")
    hits, area, word = F.col("hits"), F.col("area"), F.col("word")
    by_word = counts.groupBy("word", "area").agg(F.sum("hits").alias("hits"), F.sum("said").alias("said")).groupBy("word").agg(
        F.sum(F.when(area == "+", -hits).otherwise(hits)).alias("n"), F.sum(F.when(area == "", hits).otherwise(0)).alias("unclear"),
        F.max(F.when(~area.isin("", "+"), F.struct("hits", "area", "said"))).alias("best"),
        F.max(F.when(~area.isin("", "+"), F.col("said"))).alias("most"),
        F.sum(F.when(area == "+", -F.col("said")).otherwise(F.col("said"))).alias("all"), F.sum(F.when(area == "", F.col("said")).otherwise(0)).alias("unclear_said"),
        F.collect_list(F.when(word == "=", F.struct("area", "hits"))).alias("of"),
    )
    rows = stage(by_word.where((word == "=") | ((F.col("all") >= said) & (F.col("n") >= least))), "words")
    whole = rows.where(word == "=").first()
    units_of = {} if whole is None else {r.area: r.hits for r in whole.of}
    size, unclear = 0 if whole is None else whole.n, units_of.get("", 0)
    share = {a: n / max(size - unclear, 1) for a, n in units_of.items() if a not in ("", "+")}
    if not share:
        return _Counts({}, {}, {}, 0, 0)
    n = F.col("n") - (1 - UNCLEAR) * F.col("unclear")
    # a word said again and again in one unit counts for more than one said once
    times = F.least(F.lit(2.0), F.greatest(F.lit(1.0), (n + F.col("all")) / 2 / n)) if least < 2 else F.lit(1.0)
    bounds = {a: p + 0.4 * (1 - p) for a, p in share.items()}
    bound = F.create_map(*[F.lit(x) for of in bounds.items() for x in of])
    speaks = F.coalesce(_wilson(F.col("best.hits") * times, n * times, z, F.sqrt) >= F.element_at(bound, F.col("best.area")), F.lit(False))
    frequent = max(5, math.ceil(50 * SUPPORT * size))  # what a pattern of several words needs in its area
    known = rows.where((word != "=") & (F.length("word") > 1) & (F.col("n") >= max(least, SUPPORT * size)))
    clear = F.col("all") - F.col("unclear_said")
    known = known.select("word", "n", F.col("best.area").alias("area"), F.col("best.said").alias("hits"), clear.alias("clear"), speaks.alias("speaks"), ((F.col("n") <= COMMON * size) & (F.col("n") >= frequent) & (F.col("most") >= frequent)).alias("open"))
    # The driver gets words in a given share of the units at least: their number is bounded by a unit's words over that share.
    alone, pair = {}, []
    for r in known.where(F.col("hits").isNotNull() & (F.col("speaks") | F.col("open"))).collect():
        p = _wilson(r.hits, max(r.clear, r.hits), z)
        if r.speaks and p >= 0.5:
            alone[(r.word,)] = (r.area, p)
        # the best that a rule with this word could be is one that holds for all its sentences of the area
        if r.open and not (r.speaks and _wilson(r.hits, r.hits, z) <= p + 0.02):
            pair.append(r)
    ranked = {r.word: i for i, r in enumerate(sorted(pair, key=lambda r: (-r.n, r.word)))}
    return _Counts(alone, ranked, bounds, frequent, size - unclear)


def _transactions(rules: Rules | None, ranks: dict[str, int]) -> Mapper:
    """(grp, items, area, n): of each sentence the ranks of its open words, ascending, once a unit; of these, for
    each group of words, what stands before the group's last word (the group-dependent transactions of
    parallel FP-growth). Areas as in ``_counter``. Combined within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[tuple[int, ...], str]] = Counter()
        for b in batches:
            for labels, paragraphs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for areas, sents in _said(labels, paragraphs, rules):
                    sets = {tuple(sorted({ranks[w] for w in s[i : i + LONGEST_SENTENCE] if w in ranks})) for s in sents for i in range(0, len(s), LONGEST_SENTENCE)}
                    for a in [*(areas or [""]), *["+"] * (len(areas) - 1)]:
                        held.update((x, a) for x in sets if len(x) > 1)
            if len(held) >= HELD:
                yield _grouped(held)
                held.clear()
        yield _grouped(held)

    return run


def _grouped(held: Counter[tuple[tuple[int, ...], str]]) -> pa.RecordBatch:
    out: Counter[tuple[int, tuple[int, ...], str]] = Counter()
    for (items, area), n in held.items():
        done: set[int] = set()
        for i in range(len(items) - 1, 0, -1):
            g = items[i] % GROUPS
            if g not in done:
                done.add(g)
                out[g, items[: i + 1], area] += n
    rows = [(*k, n) for k, n in out.items()]
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    types = (pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["grp", "items", "area", "n"])


Paths = dict[tuple[int, ...], Counter[str]]


def grow(paths: Paths, ends: Callable[[int], bool], least: int, worth: Callable[[Counter[str]], bool], longest: int = LONGEST_RULE) -> Iterator[tuple[tuple[int, ...], Counter[str]]]:
    """Frequent patterns of 2 to ``longest`` items whose last item ``ends`` accepts, with their counts by area:
    FP-growth over conditional pattern bases, kept as merged prefix paths. A pattern is grown only while it is
    frequent and ``worth`` it; so a path of n items gives n over ``longest`` patterns at most."""

    def total(by: Counter[str]) -> int:
        return by.total() - 2 * by["+"]

    def grown(base: Paths, pattern: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], Counter[str]]]:
        found: dict[int, Counter[str]] = defaultdict(Counter)
        for path, by in base.items():
            for x in path:
                found[x].update(by)
        for x, by in found.items():
            if total(by) < least:
                continue
            yield (x, *pattern), by
            if len(pattern) + 1 < longest and worth(by):
                inner: Paths = defaultdict(Counter)
                for path, of in base.items():
                    if x in path and (before := path[: path.index(x)]):
                        inner[before].update(of)
                yield from grown(inner, (x, *pattern))

    bases: dict[int, Paths] = defaultdict(lambda: defaultdict(Counter))
    for path, by in paths.items():
        for i in range(1, len(path)):
            if ends(path[i]):
                bases[path[i]][path[:i]].update(by)
    for x, base in bases.items():
        if total(sum(base.values(), Counter())) >= least:
            yield from grown(base, (x,))


def _miner(least: int, bounds: dict[str, float], z: float) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = key[0].as_py()
        paths: Paths = defaultdict(Counter)
        for b in batches:
            for items, area, n in zip(*(b.column(c).to_pylist() for c in ("items", "area", "n")), strict=True):
                paths[tuple(items)][area] += n

        def best(by: Counter[str]) -> tuple[float, str, int]:
            hits, area = max(((n, a) for a, n in by.items() if a not in ("", "+")), default=(0, ""))
            return (_wilson(hits, by.total() - 2 * by["+"] - (1 - UNCLEAR) * by[""], z) if hits else 0.0), area, hits

        def worth(by: Counter[str]) -> bool:
            p, _, hits = best(by)
            return hits >= least and _wilson(hits, hits, z) > p + 0.02

        rows = []
        for items, by in grow(paths, lambda x: x % GROUPS == group, least, worth):
            p, area, hits = best(by)
            if hits >= least and p >= bounds[area]:
                rows.append((items, area, p))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["items", "area", "p"])

    return run


def pruned(found: dict[tuple[str, ...], tuple[str, float]]) -> dict[tuple[str, ...], tuple[str, float]]:
    """Without redundant rules: those whose confidence isn't above that of a rule on fewer of their words."""
    kept: dict[tuple[str, ...], tuple[str, float]] = {}
    for key in sorted(found, key=lambda k: (len(k), k)):
        parts = [s for i in range(len(key)) for s in (key[:i] + key[i + 1 :], (key[i],)) if len(key) > 1 and s in kept]
        if not any(kept[s][1] >= found[key][1] - 0.02 for s in parts):
            kept[key] = found[key]
    return kept


def mine_rules(units: DataFrame, before: Rules | None = None, *, least: int = 1, said: int = 3, z: float = 1.28, together: Callable[[int], bool] = lambda placed: True) -> Rules:
    """Class-association rules of the units' sentences, by parallel FP-growth.

    A transaction is a sentence: its words, and the areas of its unit. Rules on one word come from the counts of
    words. Words that don't speak alone are ranked by frequency; each group of them gets the parts of the
    transactions that end with its words, and grows the frequent patterns of up to LONGEST_RULE words there.
    Frequent words have short parts and rare words few, so groups are even; what grows is bounded by
    LONGEST_SENTENCE. A rule whose confidence isn't above that of a rule on fewer of its words is redundant.
    The confidence is calibrated to the lower bound that its counts support.

    before: the rules that place the unlabelled paragraphs; without them only labelled documents count.
    together: whether to look for rules on several words, given the number of units with an area."""
    if before is None:
        units = units.where(F.size("areas") > 0)
    known = _count_words(units, before, least, said, z)
    found = dict(known.rules)
    if len(known.open) > 1 and together(known.placed):
        words = list(known.open)
        parts = units.select("areas", "paragraphs").mapInArrow(_transactions(before, known.open), "grp int, items array<int>, area string, n bigint")
        merged = parts.groupBy("grp", "items", "area").agg(F.sum("n").alias("n"))
        mined = merged.groupBy("grp").applyInArrow(_miner(known.frequent, known.bounds, STRICT), "items array<int>, area string, p double")
        for r in mined.collect():  # rules alone: each on words that the driver holds, and above the support
            found[tuple(words[i] for i in r["items"])] = (r.area, r.p)
    return Rules([(k, a, p) for k, (a, p) in pruned(found).items()], known.placed)


def _sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most about ``bound`` rows, by a hash of the key; all of a smaller table."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(8)), F.lit(1 << 30)) < F.lit(int((1 << 30) * bound / n)))


def read_own_text(documents: DataFrame, labels: DataFrame, areas: DataFrame, *, read: Paragraphs = own_paragraphs) -> DataFrame:
    """(doc_id, areas, paragraphs): every document's own text in sentences, with its labels (none: an empty
    list; at most LABELLED documents have some). Read once and written to the shared folder; fitting and scoring
    start from there. Of ``labels`` (doc_id, subject_area), in any spelling, areas that ``areas`` doesn't list
    are ignored."""
    known = areas.select(normal_form(F.col("subject_area")).alias("area")).where("area is not null").distinct()
    tidy = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal_form(F.col("subject_area")).alias("area")).where("doc_id is not null")
    tidy = tidy.join(known, "area").groupBy("doc_id").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    tidy = stage(_sampled(tidy, "doc_id", LABELLED), "labels")  # bounded, so it may be broadcast
    text = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = text.join(F.broadcast(tidy), "doc_id", "left").select("doc_id", F.coalesce("areas", F.array().cast("array<string>")).alias("areas"), "text")
    return stage(both.mapInArrow(_reader(read), _READ), "own")


def fit_own(own: DataFrame, *, rounds: int = 6) -> Rules:
    """Rules from the labelled documents of ``read_own_text``, then again from these and all paragraphs of
    unlabelled ones that the rules place clearly, which brings in words that no labelled document has; until a
    round places under 1 % more paragraphs than the one before, ``rounds`` times at most."""
    # copies of a message say nothing new
    units = stage(own.where(F.size("paragraphs") > 0).select("areas", "paragraphs").dropDuplicates(), "units")
    rules = mine_rules(units, together=lambda placed: rounds < 1)
    before = 0
    for i in range(rounds if rules.rules else 0):

        def last(placed: int) -> bool:  # only the last round looks for rules on several words
            return i + 1 == rounds or placed <= 1.01 * before

        rules = mine_rules(units, rules, least=3, z=1.64, together=last)
        if last(rules.units):
            break
        before = rules.units
    return rules


def fit_rules(documents: DataFrame, labels: DataFrame, areas: DataFrame, *, rounds: int = 6, read: Paragraphs = own_paragraphs) -> Rules:
    """``fit_own`` from the documents themselves."""
    return fit_own(read_own_text(documents, labels, areas, read=read), rounds=rounds)


def _scored(rules: Rules) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, str, int, float]] = []
            for key, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: dict[str, list[float]] = {}
                for p in own:
                    if a := rules.placed(p):
                        found.setdefault(a[0], []).append(a[1])
                rows += [(key, a, len(s), sum(s)) for a, s in found.items()]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())],
                names=["doc_id", "subject_area", "paragraphs", "evidence"],
            )

    return run


def subject_areas(documents: DataFrame, rules: Rules, *, read: Paragraphs = own_paragraphs) -> DataFrame:
    """``areas_of_own`` from the documents themselves, with rules fitted before."""
    text = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array().cast("array<string>").alias("areas"), F.col("text").cast("string").alias("text"))
    return areas_of_own(text.where("doc_id is not null and text is not null").mapInArrow(_reader(read), _READ), rules)


def areas_of_own(own: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, subject_area, paragraphs, evidence): each area to which the author of a document (of
    ``read_own_text``) devotes a paragraph, with the number of such paragraphs and the evidence of the matching rules.

    Every document is scored whole, in Arrow batches, without any exchange; the rules are small. NULL ids, NULL and
    empty texts and texts without a clear paragraph give no rows; repeated documents give theirs again; no rules
    give no rows."""
    rows = own.where("doc_id is not null").select("doc_id", "paragraphs")
    return rows.mapInArrow(_scored(rules), "doc_id bigint, subject_area string, paragraphs int, evidence double")
