"""Problem 4: the subject areas of each artifact, from a latent semantic space of its filename, summary and category.

1. Filenames and summaries are cut into segments. Segments that recur are terms; running text (a segment of more than LONGEST
   words) that holds none gives its recurring words and pairs of words as terms. An artifact is the set of its terms.
2. The artifact-by-term matrix, weighted by inverse document frequency, is reduced by a truncated singular value decomposition
   (through its Gram matrix, which all artifacts are counted into; subspace iteration on the driver over bounded counts). Word
   beginnings are columns too: they bring cognates of several languages together.
3. Labelled artifacts seed several centroids for each subject. They are refined in turns: every term joins the nearest centroid
   if it is clearly nearest, and centroids move to the mean of their terms and seeds.
4. Refinement goes on over all artifacts: a term, or a text too rare for the space, belongs to the subject that the other
   mentions of its artifacts (or their labels) have more often than chance explains; a term whose artifacts seldom have its
   subject loses it. Labelled artifacts check the terms: one whose mention often comes without the subject is ambiguous.
5. An artifact is embedded as the weighted sum of its mentions. It gets the subjects that a mention belongs to and whose centroid
   the artifact itself is near by cosine similarity, so that a stray word of a long text decides nothing.
6. Words that are no term are compared with the terms by edit distance (one insertion, deletion, change or swap, or a blank less).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.io import materialize
from corpusloom.llm.quota_sample import BUCKETS, valid_buckets

#: The space is fitted on terms that at least one of so many artifacts mentions (and at least 3). An artifact has few segments, so
#: this bounds the terms on the driver: so many times the mean number of segments. Rarer ones are placed by complete counts (4.).
ONE_IN = 5_000
#: Pairs of terms enter the fit from one in so many artifacts on, which bounds the pairs on the driver in the same way.
PAIR_ONE_IN = 100_000
#: Letters of a word's beginning that is a column of its own.
STEM = 5
#: Rounds over all artifacts; least share of a text's artifacts that have its subject, and share of chance among such texts, at
#: most; share below which a term loses its subject; least cosine of an artifact and a subject.
TURNS, SHARE, CHANCE, LOST, ARTIFACT_NEAR = 2, 0.6, 0.1, 0.4, 0.2
#: Artifacts up to which the agreement is told exactly; above, in as many steps.
STEPS = 30
#: Labelled artifacts that the classifier is fitted on, at most: those with the least hash.
LABELLED = 200_000
#: Dimensions of the space: the first so many of one decomposition, which vote; centroids for each subject, rounds of refinement.
DIMENSIONS, CENTROIDS, ROUNDS = (32, 48, 64, 80, 96, 112, 128), 6, 6
#: Least cosine of a mention, greatest ratio of the second subject's, and greatest share of labelled artifacts that may contradict.
NEAR, RATIO, CONTRADICT = 0.3, 0.6, 0.012
#: Characters from which a misspelled term is looked for.
FUZZY_FROM = 5
LONGEST = 5
#: Words before something that a text is not about.
NOT_ABOUT = [
    "unrelated to", "not related to", "not about", "nothing to do with", "no relation to", "ohne bezug zu", "ohne zusammenhang mit", "nicht zu", "nichts zu tun mit",
    "sin relacion con", "no relacionado con", "nada que ver con", "sans lien avec", "sans rapport avec", "rien a voir avec",
]
_NOT_ABOUT = re.compile(rf"(?:{'|'.join(NOT_ABOUT)})\b[^)\].;…]*")
_SUFFIX = re.compile(r"\.[A-Za-z0-9]{1,5}\Z")
_SEGMENT = re.compile(r"[^\w ]+")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("’", "'").replace("ß", "ss")) if not unicodedata.combining(c)).lower()


def segments(filename: str | None, summary: str | None) -> list[str]:
    """The folded segments of both texts, without what they say they are not about; the words of a filename, without numbers and versions, are one segment."""
    out = []
    if filename:
        out.append(" ".join(w for w in re.split(r"[\W_]+", fold(_SUFFIX.sub("", filename))) if not any(c.isdigit() for c in w)).strip())
    if summary:
        out += [" ".join(s.split()) for s in _SEGMENT.split(_NOT_ABOUT.sub(".", fold(summary)).replace("'", " "))]
    return [s for s in out if s]


def grams(words: list[str]) -> set[str]:
    """The words of running text (of four letters or more) and its pairs of words."""
    return {w for w in words if len(w) >= 4 and w.isalpha()} | {f"{a} {b}" for a, b in zip(words, words[1:]) if len(a) + len(b) >= 8}


def stems(term: str) -> set[str]:
    return {w[:STEM] for w in term.split() if len(w) >= STEM}


def _deletes(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, change or swap of neighbours makes one of the other."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Terms:
    """Finds the known terms of a segment, longest first, and for the words between them terms that they may misspell."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.joined: dict[str, list[int]] = defaultdict(list)
        for t, i in self.number.items():
            if len(bare := t.replace(" ", "")) >= FUZZY_FROM:
                for d in _deletes(bare):
                    self.joined[d].append(i)
        self.bare = [t.replace(" ", "") for t in terms]
        self.words = {w for t in terms for w in t.split()}

    def find(self, segment: str) -> tuple[list[int], list[list[int]]]:
        """Terms, and for each misspelled one those it may be."""
        words, exact, fuzzy = segment.split(), [], []
        rest: list[list[str]] = [[]]
        i = 0
        while i < len(words):
            for n in range(min(LONGEST, len(words) - i), 0, -1):
                t = self.number.get(" ".join(words[i : i + n]))
                if t is not None:
                    exact.append(t)
                    rest.append([])
                    i += n
                    break
            else:
                rest[-1].append(words[i])
                i += 1
        for run in rest:
            i = 0
            while i < len(run):
                for n in range(min(LONGEST, len(run) - i), 0, -1):
                    bare = "".join(run[i : i + n])
                    if len(bare) < FUZZY_FROM or bare.isdigit():
                        continue
                    found = {t for d in _deletes(bare) for t in self.joined.get(d, ()) if near(bare, self.bare[t])}
                    if found:
                        fuzzy.append(sorted(found))
                        i += n
                        break
                else:
                    i += 1
        return exact, fuzzy


def truncated_svd(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenpairs of a sparse symmetric positive matrix (a Gram matrix: squared singular values, right vectors)."""
    k = min(k, size)
    order = np.argsort(rows, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, np.int64)

    def times(q: np.ndarray) -> np.ndarray:
        out = np.zeros_like(q)
        step = max(1, 4_000_000 // max(1, q.shape[1]))
        edges = [0, *[int(b) for b in begin[np.searchsorted(begin, np.arange(step, len(rows), step))] if b] , len(rows)] if len(rows) > step else [0, len(rows)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                inner = begin[(begin >= lo) & (begin < hi)]
                out[rows[inner]] += np.add.reduceat(values[lo:hi, None] * q[columns[lo:hi]], inner - lo, axis=0)
        return out

    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((size, min(size, k + 10))))
    for _ in range(rounds):
        q, _ = np.linalg.qr(times(q))
    value, vector = np.linalg.eigh(q.T @ times(q))
    top = np.argsort(-value)[:k]
    return np.maximum(value[top], 0), q @ vector[:, top]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def latent_space(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """A vector for each term from the weighted Gram matrix, the strongest dimensions first.

    The terms' rows are scaled by the roots of their sums first, so that a subject of a rarer language is as strong a dimension
    as one of the most frequent language.
    """
    if not len(rows):
        return np.zeros((size, 1))
    sums = np.bincount(rows, weights=values, minlength=size) + 1e-12
    strength, vectors = truncated_svd(rows, columns, values / np.sqrt(sums[rows] * sums[columns]), size, max(DIMENSIONS))
    order = np.argsort(-strength)
    return (vectors * np.sqrt(strength))[:, order]


def decide(space: np.ndarray, seen: np.ndarray, labelled: list[tuple[list[int], set[int]]], described: list[tuple[list[int], int]], subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subject of each term, -1 for none; the centroids and their subjects. ``space``: a unit vector for each term; ``seen``: its artifacts."""
    seeds: list[np.ndarray] = []
    owner: list[int] = []
    mass: list[float] = []
    for s in range(subjects):
        vectors = [space[t].sum(0) for t, of in labelled if of == {s} and t] + [space[t].sum(0) for t, of in described if of == s and t]
        if not vectors:
            continue
        x = _unit(np.array(vectors))
        chosen = [int((x @ x.mean(0)).argmax())]
        while len(chosen) < min(CENTROIDS, len(x)):  # the seed that is farthest from all chosen ones
            far = (x @ x[chosen].T).max(1)
            if far.min() > 0.6:
                break
            chosen.append(int(far.argmin()))
        c = x[chosen]
        for _ in range(ROUNDS):
            own = (x @ c.T).argmax(1)
            c = _unit(np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))]))
        own = np.bincount((x @ c.T).argmax(1), minlength=len(c))
        seeds += list(c)
        owner += [s] * len(c)
        mass += own.tolist()
    decided = np.full(len(space), -1)
    if not seeds:
        return decided, np.zeros((0, space.shape[1])), np.zeros(0, int)
    owners, first, weight = np.array(owner), np.array(seeds), np.array(mass)[:, None]
    centroids = first
    for _ in range(ROUNDS):
        cosine = space @ centroids.T
        by_subject = np.stack([cosine[:, owners == s].max(1) if (owners == s).any() else np.full(len(space), -1.0) for s in range(subjects)], 1)
        best = by_subject.argmax(1)
        top = by_subject[np.arange(len(space)), best]
        second = np.partition(by_subject, -2, axis=1)[:, -2] if subjects > 1 else np.zeros(len(space))
        decided = np.where((top >= NEAR) & (second <= RATIO * top), best, -1)
        nearest = cosine.argmax(1)
        moved = first * weight
        for j in range(len(centroids)):
            mine = (nearest == j) & (decided == owners[j])
            moved[j] = moved[j] + (np.sqrt(seen[mine])[:, None] * space[mine]).sum(0)
        centroids = _unit(moved)
    return np.where(contradicted(decided, labelled), -1, decided), centroids, owners


def voted(space: np.ndarray, seen: np.ndarray, labelled: list[tuple[list[int], set[int]]], described: list[tuple[list[int], int]], subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``decide`` in the first dimensions of ``space``, by each of DIMENSIONS: the subject that half of them and three of four that decide agree on.

    The centroids are those of all dimensions.
    """
    votes = np.zeros((len(space), subjects + 1))
    for k in DIMENSIONS:
        decided, centroids, owners = decide(_unit(space[:, :k]), seen, labelled, described, subjects)
        votes[np.arange(len(space)), decided] += decided >= 0
    top = votes.max(1)
    return np.where((top * 2 >= len(DIMENSIONS)) & (top >= 0.75 * votes.sum(1)), votes.argmax(1), -1), centroids, owners


def contradicted(decided: np.ndarray, labelled: list[tuple[list[int], set[int]]]) -> np.ndarray:
    """Labels are complete: labelled artifacts that mention a term but lack its subject speak against it."""
    mentioned, against = np.zeros(len(decided)), np.zeros(len(decided))
    for terms, of in labelled:
        for t in set(terms):
            mentioned[t] += 1
            against[t] += decided[t] >= 0 and decided[t] not in of
    return against > CONTRADICT * mentioned


def agreement_needed(cells: dict[tuple[int, int], int], rates: np.ndarray) -> dict[int, int]:
    """From how many agreeing artifacts on a text of so many artifacts has a subject, rather than by chance.

    ``cells``: texts by (artifacts, those that have the text's most frequent subject), up to STEPS artifacts. ``rates``: the share
    of all artifacts that have each subject. Texts with little agreement tell how many texts have no subject, and the binomial
    distribution how many of these agree by chance; they may be CHANCE of all that are accepted.
    """
    need: dict[int, int] = {}
    for n in {n for n, _ in cells}:
        of = np.array([cells.get((n, k), 0) for k in range(n + 1)], float)
        terms = np.array([[comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)] for p in rates.tolist()]).reshape(-1, n + 1)
        tail = np.minimum(1, terms[:, ::-1].cumsum(1)[:, ::-1].sum(0))
        low = max((k for k in range(n + 1) if tail[k] > 0.5), default=0)
        none = of[: low + 1].sum() / max(1e-9, 1 - (tail[low + 1] if low < n else 0))
        for k in range(int(np.ceil(SHARE * n)), n + 1):
            if of[k:].sum() and none * tail[k] <= CHANCE * of[k:].sum():
                need[n] = k
                break
    return need


class Subjects:
    """Columns used: evidence artifact_id, filename, content_summary; classifications row_id, log_pos, bucket_number; areas subject,
    description; labels artifact_id, subject.

    Several rows of one artifact count together. Null and empty texts mention nothing; rows without an id are left out; repeated
    labels and labels of unknown subjects or artifacts are harmless. Labelled artifacts keep exactly their labels. Without
    areas, or without any labelled artifact or described term, only the labels come out; no evidence, no rows.
    """

    MAX_AREAS = 10_000

    def __init__(self, evidence: DataFrame, classifications: DataFrame, areas: DataFrame, labels: DataFrame):
        named = areas.select("subject", "description").na.drop(subset=["subject"]).orderBy("subject", "description").limit(self.MAX_AREAS + 1).collect()
        if len(named) > self.MAX_AREAS:
            raise ValueError(f"more than {self.MAX_AREAS} subject areas")
        self.subjects = sorted({r["subject"] for r in named})
        self.artifacts = evidence.filter(F.col("artifact_id").isNotNull()).select("artifact_id", "filename", "content_summary")
        self.labels = labels.select("artifact_id", "subject").na.drop().filter(F.col("subject").isin(self.subjects) if self.subjects else F.lit(False)).distinct()
        self.classifications = classifications
        number = {s: i for i, s in enumerate(self.subjects)}

        terms, artifacts = self._terms()
        self.terms = Terms(terms)
        self.mentions, more = self._with_grams(self._mentions(), len(terms), artifacts)
        terms = terms + more
        seen, (rows, columns, counts) = self._counts(terms, artifacts)
        size = len(seen)
        weight = np.log(max(artifacts, 1) / np.maximum(seen, 1)) + 1e-3
        self.space = latent_space(rows, columns, counts * weight[rows] * weight[columns], size)[: len(terms)]
        self.weight = weight[: len(terms)]
        labelled = self._labelled(number)
        described = [([t for s in segments(None, r["description"]) for t in self.terms.find(s)[0]], number[r["subject"]]) for r in named]
        decided, self.centroids, self.owners = voted(self.space, seen[: len(terms)], labelled, described, len(self.subjects))
        self.decided, self.placed = decided, self._spark.createDataFrame([], "text string, subject int")
        for _ in range(TURNS if len(self.centroids) else 0):
            self._turn(labelled)

    @property
    def _spark(self) -> SparkSession:
        return self.artifacts.sparkSession

    def _terms(self) -> tuple[list[str], int]:
        def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                rows = []
                for a, f, c in zip(*(c.to_pylist() for c in batch.columns)):
                    rows += [(a, x) for x in {x for x in segments(f, c) if x.count(" ") < LONGEST}]
                ids, parts = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string())], ["artifact_id", "segment"])

        artifacts = self.artifacts.agg(F.countDistinct("artifact_id")).first()[0]
        # a pair is counted once: two aggregations, the first combined on the map side
        pairs = self.artifacts.mapInArrow(cut, "artifact_id long, segment string").distinct()
        counts = pairs.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(3, artifacts // ONE_IN)).collect()
        number = {r["segment"]: r["n"] for r in counts if any(c.isalpha() for c in r["segment"])}
        # "covers x" is x where x by itself is the more frequent
        shorter = lambda t: any(number.get(t.split(" ", i)[i], 0) > n for i in range(1, len(t.split())) for n in (number[t],))
        return sorted(t for t in number if not shorter(t)), artifacts

    def _mentions(self) -> DataFrame:
        """artifact_id, term, exact, choice, text, gram: a mention; of a misspelled term a row for each one it may be, with one ``choice``.

        What is no term has the term -1 and its ``text``: a segment, or a word or pair of words of running text (a ``gram``).
        """
        terms = self.terms

        def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                rows = set()
                for a, f, c in zip(*(c.to_pylist() for c in batch.columns)):
                    for s in segments(f, c):
                        exact, fuzzy = terms.find(s)
                        rows.update((a, t, True, t, None, False) for t in exact)
                        rows.update((a, t, False, some[0], None, False) for some in fuzzy for t in some)
                        if not exact and not fuzzy and any(c.isalpha() for c in s):
                            rows.update([(a, -1, False, -1, s, False)] if s.count(" ") < LONGEST else ((a, -1, False, -1, x, True) for x in grams(s.split())))
                columns = zip(*rows) if rows else [()] * 6
                kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["artifact_id", "term", "exact", "choice", "text", "gram"])

        return materialize(self.artifacts.mapInArrow(find, "artifact_id long, term int, exact boolean, choice int, text string, gram boolean").distinct(), "mentions")

    def _with_grams(self, mentions: DataFrame, terms: int, artifacts: int) -> tuple[DataFrame, list[str]]:
        """The mentions, where frequent words and pairs of words of running text are terms too, numbered from ``terms`` on."""
        counts = mentions.filter("gram").groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(3, artifacts // ONE_IN))
        more = sorted(r["text"] for r in counts.collect())
        numbered = self._spark.createDataFrame([(x, terms + i) for i, x in enumerate(more)], "text string, number int")
        met = mentions.join(F.broadcast(numbered), "text", "left")  # bounded like the terms
        number = F.when(F.col("gram"), F.col("number"))
        columns = ["artifact_id", F.coalesce(number, "term").alias("term"), (F.col("exact") | number.isNotNull()).alias("exact"), "choice", F.when(number.isNull(), F.col("text")).alias("text")]
        return (materialize(met.select(*columns), "mentions") if more else mentions.drop("gram")), more

    def _counts(self, names: list[str], artifacts: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Artifacts of each term (and of each category and word beginning, which count as terms of their own), and of each pair of terms."""
        terms = len(names)
        shared = Counter(x for t in names for x in stems(t))
        extra = {x: terms + max(BUCKETS) + 1 + i for i, x in enumerate(sorted(x for x, n in shared.items() if n > 1))}
        begins = self._spark.createDataFrame([(t, extra[x]) for t, name in enumerate(names) for x in stems(name) if x in extra], "term int, stem int")
        buckets = valid_buckets(self.classifications).filter(F.col("bucket_number").isin(*BUCKETS))
        ids = self.artifacts.select("artifact_id").distinct()
        categories = ids.join(buckets.withColumnRenamed("row_id", "artifact_id"), "artifact_id").select("artifact_id", (F.col("bucket_number") + terms).cast("int").alias("term"))
        exact = self.mentions.filter("exact").select("artifact_id", "term")
        every = exact.unionAll(categories).unionAll(exact.join(F.broadcast(begins), "term").select("artifact_id", F.col("stem").alias("term")))  # the words of the terms
        of = every.groupBy("artifact_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))  # bounded by a filename and a summary
        pairs = of.select(F.explode("terms").alias("a"), "terms").select("a", F.explode("terms").alias("b")).filter("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        kept = pairs.filter((F.col("a") == F.col("b")) | (F.col("n") >= max(1, artifacts // PAIR_ONE_IN))).toPandas()
        a, b, n = (kept[c].to_numpy() for c in ("a", "b", "n"))
        size = terms + max(BUCKETS) + 1 + len(extra)
        seen = np.zeros(size)
        seen[a[a == b]] = n[a == b]
        off = a != b
        return seen, (np.concatenate([a, b[off]]), np.concatenate([b, a[off]]), np.concatenate([n, n[off]]).astype(float))

    def _labelled(self, number: dict[str, int]) -> list[tuple[list[int], set[int]]]:
        chosen = self.labels.groupBy("artifact_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("artifact_id"), "artifact_id").limit(LABELLED)
        mentioned = self.mentions.filter("exact").join(chosen, "artifact_id").groupBy("artifact_id").agg(F.collect_set("term").alias("terms"), F.first("subjects").alias("subjects"))
        return [(r["terms"], {number[s] for s in r["subjects"]}) for r in mentioned.collect()]

    def _decided(self, rows: DataFrame) -> DataFrame:
        """Mentions with the number of their ``subject``, null for none."""
        known = self._spark.createDataFrame([(t, s) for t, s in enumerate(self.decided.tolist()) if s >= 0], "term int, known int")
        rare = rows.filter("term < 0").join(self.placed, "text", "left").select(*rows.columns, "subject")
        return rows.filter("term >= 0").join(F.broadcast(known), "term", "left").select(*rows.columns, F.col("known").alias("subject")).unionAll(rare)  # terms are bounded, see ONE_IN

    def _turn(self, labelled: list[tuple[list[int], set[int]]]) -> None:
        """One refinement over all artifacts: counts, for each term and rare text, of its artifacts by the subjects they have otherwise."""
        number = F.create_map(*[F.lit(x) for i, s in enumerate(self.subjects) for x in (s, i)])
        units = materialize(self._decided(self.mentions.filter("exact OR term < 0")), "units")
        has = units.filter("subject IS NOT NULL").groupBy("artifact_id", "subject").agg(F.count(F.lit(1)).alias("n"))
        labels = self.labels.select("artifact_id", number[F.col("subject")].alias("subject"), F.lit(2**40).alias("n"))
        # where there are labels, only they count
        every = has.withColumn("labelled", F.lit(False)).unionAll(labels.withColumn("labelled", F.lit(True)))
        of = every.groupBy("artifact_id").agg(F.max("labelled").alias("labelled"), F.collect_list(F.struct("labelled", "subject", "n")).alias("all"))  # at most the subjects
        of = of.select("artifact_id", F.transform(F.filter("all", lambda x: x["labelled"] == F.col("labelled")), lambda x: F.struct(x["subject"].alias("s"), x["n"].alias("n"))).alias("had"))
        of = materialize(of, "had")
        rates = of.select(F.explode("had.s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each subject
        whole = max(1, of.count())
        others = F.transform(F.filter("had", lambda x: x["n"] > F.coalesce((F.col("subject") == x["s"]).cast("int"), F.lit(0))), lambda x: x["s"])
        met = units.join(of, "artifact_id").select("term", "text", others.alias("others")).filter(F.size("others") > 0)
        counted = met.select("term", "text", F.explode(F.concat(F.array(F.lit(-1)), "others")).alias("s")).groupBy("term", "text", "s").agg(F.count(F.lit(1)).alias("n"))
        counted = materialize(counted, "counted")
        best = counted.groupBy("term", "text").agg(F.max(F.when(F.col("s") < 0, F.col("n"))).alias("n"), F.max(F.when(F.col("s") >= 0, F.struct("n", (-F.col("s")).alias("less")))).alias("top"))
        best = materialize(best.select("term", "text", "n", F.col("top.n").alias("k"), (-F.col("top.less")).alias("s")).filter("n >= 2 OR term >= 0"), "best")
        steps, agreeing = F.least("n", F.lit(STEPS)), F.when(F.col("n") > STEPS, F.floor(F.col("k") * STEPS / F.col("n"))).otherwise(F.col("k"))
        cells = best.groupBy(steps.alias("n"), agreeing.alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()  # at most STEPS squared rows
        need = agreement_needed({(r["n"], r["k"]): r["m"] for r in cells}, np.array([r["n"] / whole for r in rates]))
        enough = F.create_map(*[F.lit(x) for n, k in need.items() for x in (n, k)])[steps] if need else F.lit(None)
        accepted = best.withColumn("ok", F.coalesce(agreeing >= enough, F.lit(False)))
        self.placed = materialize(accepted.filter("term < 0 AND ok").select("text", F.col("s").alias("subject")), "placed")
        own = counted.filter("term >= 0").select("term", "s", "n").collect()  # bounded by the terms and subjects
        supports = {(r["term"], r["s"]): r["n"] for r in own}
        new = self.decided.copy()
        for r in accepted.filter("term >= 0").select("term", "s", "ok").collect():
            t, n = r["term"], supports[r["term"], -1]
            if self.decided[t] < 0:
                new[t] = r["s"] if r["ok"] else -1
            elif n >= 3 and supports.get((t, self.decided[t]), 0) < LOST * n:
                new[t] = r["s"] if r["ok"] else -1
        self.decided = np.where((new != self.decided) & contradicted(new, labelled), -1, new)

    def assigned(self) -> DataFrame:
        """artifact_id, subject."""
        subjects, space, weight, owners, centroids = self.subjects, _unit(self.space).astype(np.float32), self.weight, self.owners, self.centroids.astype(np.float32)
        middle = np.stack([_unit(centroids[owners == s].sum(0)) if (owners == s).any() else np.zeros(space.shape[1]) for s in range(len(subjects))]) if len(subjects) else np.zeros((0, space.shape[1]))
        # a term that all artifacts placed, against the space, stands where its subject is
        for s in range(len(subjects)):
            of, mine = owners == s, self.decided == s
            if of.any() and mine.any():
                space[mine] = np.where((space[mine] @ centroids[of].T).max(1, keepdims=True) >= NEAR, space[mine], middle[s])

        most, count = float(weight.max(initial=1.0)), max(1, len(subjects))

        def judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                of = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                term, exact, choice, subject = (flat.field(c).fill_null(v).to_numpy(zero_copy_only=False) for c, v in (("term", -1), ("exact", False), ("choice", -1), ("subject", -1)))
                # a misspelled mention counts if all terms that it may be agree
                fuzzy = np.flatnonzero(~exact & (term >= 0))
                key, place = np.unique(np.stack([of[fuzzy], choice[fuzzy]], 1), axis=0, return_inverse=True)
                low, high = np.full(len(key), count), np.full(len(key), -1)
                np.minimum.at(low, place.ravel(), subject[fuzzy])
                np.maximum.at(high, place.ravel(), subject[fuzzy])
                agreed = np.flatnonzero((low == high) & (low >= 0))
                known, rare = np.flatnonzero(exact), np.flatnonzero((term < 0) & (subject >= 0))
                where = np.concatenate([of[known], of[rare], key[agreed, 0]])
                parts = np.concatenate([space[term[known]] * weight[term[known], None], most * middle[subject[rare]], most * middle[low[agreed]]]).astype(np.float32)
                named = np.concatenate([of[known] * count + subject[known], of[rare] * count + subject[rare], key[agreed, 0] * count + low[agreed]])
                named = np.unique(named[np.concatenate([subject[known] >= 0, np.ones(len(rare) + len(agreed), bool)])])
                order = np.argsort(where, kind="stable")
                begin = np.flatnonzero(np.diff(where[order], prepend=-1))
                vectors = np.zeros((len(ids), space.shape[1]), np.float32)
                if len(begin):
                    vectors[where[order][begin]] = np.add.reduceat(parts[order], begin, axis=0)
                cosine = np.maximum(vectors @ centroids.T, vectors @ middle[owners].T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                near = np.stack([cosine[:, owners == s].max(1, initial=-1.0) >= ARTIFACT_NEAR if (owners == s).any() else np.ones(len(ids), bool) for s in range(count)], 1)
                named = named[near[named // count, named % count]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[named // count], pa.int64()), pa.array([subjects[s] for s in (named % count).tolist()], pa.string())], ["artifact_id", "subject"])

        rows = self._decided(self.mentions).filter("term >= 0 OR subject IS NOT NULL")
        of = rows.groupBy("artifact_id").agg(F.collect_list(F.struct("term", "exact", "choice", "subject")).alias("mentions"))  # bounded by a filename and a summary
        found = of.mapInArrow(judged, "artifact_id long, subject string")
        known = self.labels.join(self.artifacts.select("artifact_id").distinct(), "artifact_id", "left_semi")
        return found.join(self.labels.select("artifact_id").distinct(), "artifact_id", "left_anti").unionAll(known.select("artifact_id", "subject"))

    def composition(self) -> DataFrame:
        """subject, artifacts, share_bp (in ten-thousandths of all artifacts)."""
        whole = self.artifacts.agg(F.countDistinct("artifact_id").alias("whole"))
        counted = self.assigned().groupBy("subject").agg(F.count(F.lit(1)).alias("artifacts"))
        return counted.crossJoin(F.broadcast(whole)).select("subject", "artifacts", F.floor(F.col("artifacts") * 10000 / F.col("whole")).cast("long").alias("share_bp"))  # one row
