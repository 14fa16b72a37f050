"""Ranking people by their works.

Tables: people (professor_id, name, university_id, department_type,
verification_status, duplicate_of), universities (university_id, name), links
(professor_id, work_id), works (work_id, title, abstract, publication_year, doi,
source_name), vectors (work_id, embedding).

A query batch is of bounded size and broadcast; larger batches are searched in parts.  Where a
work lies, its text is reduced to what the batch meets of it: the places of query terms in title
and abstract, the queries whose phrase it has, and a digest of its title key.  Only that and the
vector travel, to the work's people.  There the works come by person and title, are scored against
all queries at once, and a person's best five are kept as they come by.  A task gives the people who
may be among its best, so no row for each query and work is made or shuffled.

``prepare_works`` is what an index keeps of a work; with an index (``searchindex``) only works
of people who may be among the best are scored.  Ranked works, a row for each query and work, are
a plan of their own, for those who ask for them.

Scoring: a batch of works is scored by counts of common terms, for titles and abstracts, and by a
matrix product of works by dimensions.  Words are looked up among the query terms all at once.  A
phrase is looked for only in works that have all its terms.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, vectors
from ..scratch import cut
from . import searchindex

#: Query rows that are broadcast to every work at once.
QUERY_BATCH = 1000
#: Scores that a task holds at once.
SCORES = 1 << 18
#: Scores that agree to this many places are ties; the last bits of a cosine depend
#: on the order of a sum.
TIE_PLACES = 12
HIT = ["query_id", "professor_id", "professor_name", "university_name", "score", "total_work_count"]


def searchable(people: DataFrame) -> DataFrame:
    """Verified people that are no duplicates."""
    return people.where((F.col("verification_status") == "verified") & F.col("duplicate_of").isNull())


def prepare_works(works: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Works that have a vector, with tokens, title key and preprint mark.  Worth
    writing as a table where many searches follow."""
    return _described(works.join(_present(embeddings), "work_id"))


def _present(embeddings: DataFrame) -> DataFrame:
    return embeddings.where(F.size("embedding") > 0).select("work_id", "embedding")


def _described(works: DataFrame) -> DataFrame:
    key = text.title_key(F.col("title"))
    return works.select(
        "work_id",
        "title",
        "publication_year",
        "doi",
        "source_name",
        *[c for c in ("embedding",) if c in works.columns],
        text.search_tokens(F.col("title")).alias("title_tokens"),
        text.search_tokens(F.col("abstract")).alias("abstract_tokens"),
        F.when(key != "", key).otherwise(F.col("work_id").cast("string")).alias("title_key"),
        text.is_preprint(F.col("source_name"), F.col("doi")).alias("preprint"),
    )


def query_rows(queries: DataFrame, dim: int, backend: str = "hash", encoders: dict[str, Callable] | None = None) -> DataFrame:
    """(query_id, query) with the normalised text, its tokens and its vector, by the
    backend that made the works' vectors."""
    ready = queries.select("query_id", text.normalize_query(F.col("query")).alias("q"))
    vector = vectors.embed(ready, "query_id", "q", backend, dim, encoders)
    return ready.join(vector, "query_id").select("query_id", text.search_tokens(F.col("q")).alias("query_tokens"), F.col("embedding").alias("query_vector"))


@dataclass(frozen=True)
class Asked:
    """A part of a query batch as each task needs it: ids, which terms a query has, how
    many, the phrase (or "") and the unit vector, grouped by the vectors' length."""

    ids: np.ndarray
    place: dict[str, int]
    terms: np.ndarray  # queries x terms, 0 or 1
    owners: np.ndarray  # the queries that have a term, term by term
    edges: np.ndarray  # where in owners a term begins
    phrases: list[str]
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]  # length: queries, rows

    @classmethod
    def of(cls, rows: list[Row]) -> Asked:
        terms = [[t for t in r["query_tokens"] if len(t) > 2] for r in rows]
        place = {t: i for i, t in enumerate(dict.fromkeys(itertools.chain(*terms)))}
        has = np.zeros((len(rows), len(place)), np.float32)
        for i, own in enumerate(terms):
            has[i, [place[t] for t in own]] = 1
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r["query_vector"]), []).append(i)
        unit = {n: (np.array(own), _unit(np.array([rows[i]["query_vector"] for i in own], np.float64))) for n, own in by.items()}
        term, owners = np.nonzero(has.T)
        return cls(np.array([r["query_id"] for r in rows], np.int64), place, has, owners, np.searchsorted(term, np.arange(len(place) + 1)), [" ".join(t) if len(t) > 1 else "" for t in terms], unit)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _incidence(lists: pa.ListArray, terms: pa.Array) -> np.ndarray:
    """Works x terms, 1 where a work has the term."""
    out = np.zeros((len(lists), len(terms)), np.float32)
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    out[row[at >= 0], at[at >= 0]] = 1
    return out


def _cosines(column: pa.ListArray, asked: Asked) -> np.ndarray:
    """Queries x works; 0 where the lengths differ."""
    out = np.zeros((len(asked.ids), len(column)))
    sizes = np.diff(column.offsets.to_numpy())
    for n, (queries, rows) in asked.vectors.items():
        own = np.flatnonzero(sizes == n)
        if len(own) and n:
            x = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), n)
            out[np.ix_(queries, own)] = rows @ _unit(x).T
    return out


def score_works(prepared: DataFrame, ready: DataFrame) -> DataFrame:
    """(query_id, work_id, work_score) of every work for every query; where ``prepared``
    has a column ``asked_by`` of query ids, for these."""
    return _united(prepared.sparkSession, (_score_part(prepared, shared) for shared in _parts(ready)), SCORED)


SCORED = "query_id bigint, work_id bigint, work_score double"


def _parts(ready: DataFrame) -> Iterator[Broadcast[Asked]]:
    rows = cut(ready).orderBy("query_id").toLocalIterator()
    while part := list(itertools.islice(rows, QUERY_BATCH)):
        yield ready.sparkSession.sparkContext.broadcast(Asked.of(part))


def _united(spark: SparkSession, parts: Iterable[DataFrame], schema: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts) if (parts := list(parts)) else spark.createDataFrame([], schema)


def _score_part(prepared: DataFrame, shared: Broadcast[Asked]) -> DataFrame:
    asked, some = shared.value, "asked_by" in prepared.columns
    found = prepared.select(F.col("work_id").cast("bigint").alias("work_id"), "embedding", "title_tokens", "abstract_tokens", *(["asked_by"] if some else []))
    if some:
        found = found.withColumn("asked_by", F.array_intersect("asked_by", F.lit([int(i) for i in asked.ids]).cast("array<bigint>"))).where(F.size("asked_by") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        sizes, terms = q.terms.sum(axis=1), pa.array(list(q.place), pa.string())
        phrased, step = np.array([bool(p) for p in q.phrases]), max(1, SCORES // len(q.ids))
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            score = 0.65 * _cosines(batch.column(1), q)
            best = np.zeros(score.shape)
            for k, (weight, part) in enumerate(((0.2, 1.0), (0.1, 0.5))):
                lists = batch.column(2 + k)
                common = (q.terms @ _incidence(lists, terms).T).astype(np.float64)
                score += weight * common / np.maximum(sizes, 1)[:, None]
                texts: dict[int, str] = {}
                for i, j in np.argwhere((common == sizes[:, None]) & phrased[:, None]).tolist():
                    if j not in texts:
                        texts[j] = " ".join(lists[j].as_py())
                    if q.phrases[i] in texts[j]:
                        best[i, j] = max(best[i, j], part)
            score = np.round(score + 0.05 * best, TIE_PLACES)
            n = batch.num_rows
            if some:
                asking = batch.column(4)
                j = np.repeat(np.arange(n), np.diff(asking.offsets.to_numpy()))
                ids = asking.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).take(pa.array(j)), pa.array(score[np.searchsorted(q.ids, ids), j])], names=["query_id", "work_id", "work_score"])
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.ids, n)), pa.array(np.tile(batch.column(0).to_numpy(), len(q.ids))), pa.array(score.ravel())], names=["query_id", "work_id", "work_score"])

    return found.mapInArrow(run, SCORED)


#: What of a work's text the queries meet: places of terms, and of queries whose phrase it has.
MET = ("title_terms", "title_phrases", "abstract_terms", "abstract_phrases")
#: More than sums of scores differ by rounding to four places.
SLACK = 2e-4
LED = "query_id bigint, professor_id bigint, best array<double>, titles bigint"


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    """n lists, of the values whose row, ascending, is theirs."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(value.astype(np.int32)))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)


def _common(row: np.ndarray, term: np.ndarray, n: int, asked: Asked) -> np.ndarray:
    """Works x queries: how many of a query's terms a work has, from pairs of a work and a term."""
    q, out = len(asked.ids), np.zeros(n * len(asked.ids), np.int64)
    many = np.diff(asked.edges)[term]
    ends, lo = np.cumsum(many), 0
    while lo < len(term):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SCORES, side="right")))
        own = many[lo:hi]
        at = np.repeat(asked.edges[term[lo:hi]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        out += np.bincount(np.repeat(row[lo:hi] * q, own) + asked.owners[at], minlength=n * q)
        lo = hi
    return out.reshape(n, q)


def _met(works: DataFrame, shared: Broadcast[Asked]) -> DataFrame:
    """``works`` with ``MET`` in place of title_tokens and abstract_tokens."""
    rows = works.select(*[c for c in works.columns if not c.endswith("_tokens")], "title_tokens", "abstract_tokens")
    kept = rows.schema[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        sizes, terms = q.terms.sum(axis=1), pa.array(list(q.place), pa.string())
        phrased, step = np.array([bool(p) for p in q.phrases]), max(1, SCORES // len(q.ids))
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            n, out = batch.num_rows, batch.columns[:-2]
            for lists in batch.columns[-2:]:
                row, words = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten()
                at = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy()
                row, term = np.divmod(np.unique(row[at >= 0] * len(terms) + at[at >= 0]), max(1, len(terms)))
                work, query = np.nonzero((_common(row, term, n, q) == sizes) & phrased)
                texts = {j: " ".join(lists[j].as_py()) for j in np.unique(work).tolist()}
                has = np.array([q.phrases[i] in texts[j] for j, i in zip(work.tolist(), query.tolist(), strict=True)], bool)
                out += [_lists(row, term, n), _lists(work[has], query[has], n)]
            yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in kept), *MET])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} array<int>" for c in MET)]))


def _scores(batch: pa.RecordBatch, asked: Asked) -> np.ndarray:
    """Queries x works, from works that ``_met`` has seen; of rows of one query id the better."""
    score, sizes = 0.65 * _cosines(batch.column("embedding"), asked), np.maximum(asked.terms.sum(axis=1), 1)[:, None]
    best = np.zeros(score.shape)
    for weight, part, name in ((0.1, 0.5, "abstract"), (0.2, 1.0, "title")):
        work, query = _flat(batch.column(f"{name}_phrases"))
        best[query, work] = part
    for weight, name in ((0.2, "title"), (0.1, "abstract")):
        score += weight * _common(*_flat(batch.column(f"{name}_terms")), batch.num_rows, asked).T.astype(np.float64) / sizes
    score, begins = np.round(score + 0.05 * best, TIE_PLACES), np.flatnonzero(np.append(True, asked.ids[1:] != asked.ids[:-1]))
    return score if len(begins) == len(score) else np.maximum.reduceat(score, begins, axis=0)


def _best(values: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, or all, greatest first."""
    if values.shape[1] > k:
        values = -np.partition(-values, k - 1, axis=1)[:, :k]
    return -np.sort(-values, axis=1)


def _bests(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[list[tuple[tuple[int, int], np.ndarray, int]]]:
    """For works in the order of person, part, title and preprint: (person, parts), queries x
    their best works, and how many titles; as many at a time as a batch brings to an end."""
    top, step = len(scoring.TOP_WORK_WEIGHTS), max(1, SCORES // len(asked.ids))
    held = owner = best = None  # the last title, of which more works may come, and the last person
    titles = 0
    for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
        done, score = [], _scores(batch, asked)
        key = np.column_stack([*(batch.column(c).to_numpy().astype(np.int64) for c in ("professor_id", "parts", "part")), np.frombuffer(b"".join(batch.column("title_digest").to_pylist()), np.int64).reshape(-1, 2)])
        late = batch.column("preprint").to_numpy(zero_copy_only=False).astype(bool)
        new = np.append(True, (key[1:] != key[:-1]).any(axis=1))
        begins = np.flatnonzero(new)
        first, names = late[begins], key[begins]
        more = held is not None and (held[0] == names[0]).all()
        if more:
            first[0] = held[1]
        score[:, late != first[np.cumsum(new) - 1]] = -np.inf  # a preprint of what is published
        found = np.maximum.reduceat(score, begins, axis=1)
        if more:
            found[:, 0] = np.maximum(found[:, 0], held[2])
        elif held is not None:
            found, names = np.column_stack([held[2], found]), np.vstack([held[0], names])
        held = names[-1], first[-1], found[:, -1].copy()
        found, people = found[:, :-1], names[:-1, :3]
        edges = np.flatnonzero(np.append(True, (people[1:] != people[:-1]).any(axis=1))) if len(people) else np.zeros(0, np.int64)
        for a, z in itertools.pairwise([*edges.tolist(), len(people)]):
            own = tuple(people[a].tolist())
            if own != owner:
                if owner is not None:
                    done.append((owner[:2], best, titles))
                owner, best, titles = own, np.zeros((len(found), 0)), 0
            best, titles = _best(np.hstack([best, found[:, a:z]]), top), titles + z - a
        if done:
            yield done
    if held is not None:
        last = tuple(held[0][:3].tolist())
        if last == owner:
            yield [(owner[:2], _best(np.column_stack([best, held[2]]), top), titles + 1)]
        else:
            yield [*([(owner[:2], best, titles)] if owner is not None else []), (last[:2], held[2][:, None], 1)]


def _leading(theirs: DataFrame, shared: Broadcast[Asked], limit: int | None, work_limit: int) -> DataFrame:
    """``LED``: the best works of the people who may be among the best of their task, and of
    all whose works lie in several parts."""
    weights, top = np.array(scoring.TOP_WORK_WEIGHTS[:work_limit]), len(scoring.TOP_WORK_WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        ids = np.unique(q.ids)
        lead = np.full((len(ids), max(1, limit or 1)), -np.inf)
        for done in _bests(batches, q):
            bests = np.full((len(done), len(ids), top), -np.inf)
            for k, (_, best, _) in enumerate(done):
                bests[k, :, : best.shape[1]] = best
            person, whole, titles = (np.array(x) for x in zip(*((o[0], o[1] == 1, n) for o, _, n in done), strict=True))
            sums = np.where(bests == -np.inf, 0, bests)[:, :, : len(weights)] @ weights
            keep = np.ones(sums.shape, bool)
            if limit is not None:
                lead = _best(np.hstack([lead, sums[whole].T]), lead.shape[1])
                keep = (sums >= lead[:, -1] - SLACK) | ~whole[:, None]
            j, i = np.nonzero(keep)
            some = bests[j, i]
            ends = np.append(0, np.cumsum((some != -np.inf).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(person[j]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(some[some != -np.inf])), pa.array(titles[j])], names=["query_id", "professor_id", "best", "titles"])

    rows = theirs.repartition("professor_id", "part").sortWithinPartitions("professor_id", "part", "title_digest", "preprint")
    return rows.mapInArrow(run, LED)


def people_sums(tables: dict[str, DataFrame], parts: list[Broadcast[Asked]], result_limit: int | None, work_limit: int) -> DataFrame:
    """(query_id, professor_id, score, total_work_count) of people who may be among the best,
    as ``ranked_works`` and ``rank_people`` have them."""
    digest = lambda c: F.unhex(F.md5(c.cast("binary"))).alias("title_digest")
    if "prepared" in tables:
        works = tables["prepared"].select("work_id", digest(F.col("title_key")), "preprint", "embedding", "title_tokens", "abstract_tokens")
    else:
        works = _described(tables["works"]).select("work_id", digest(F.col("title_key")), "preprint", "title_tokens", "abstract_tokens")
    who = searchable(tables["people"]).join(tables["universities"].select("university_id"), "university_id", "left_semi").select("professor_id")
    links = tables["links"].select("professor_id", "work_id").distinct().join(who, "professor_id", "left_semi")
    sizes = links.groupBy("professor_id").agg(F.ceil(F.count("*") / searchindex.ROW_WORKS).cast("int").alias("parts"))

    def led(shared: Broadcast[Asked]) -> DataFrame:
        met = _met(works, shared)
        if "embedding" not in met.columns:
            met = met.join(_present(tables["vectors"]), "work_id")
        theirs = links.join(sizes, "professor_id").join(met.hint("merge"), "work_id").drop("work_id")
        theirs = theirs.withColumns({"professor_id": F.col("professor_id").cast("bigint"), "part": F.pmod(F.xxhash64("title_digest"), "parts").cast("int")})
        return _leading(theirs, shared, result_limit, work_limit)

    whole = _united(links.sparkSession, map(led, parts), LED).groupBy("query_id", "professor_id").agg(F.flatten(F.collect_list("best")).alias("best"), F.sum("titles").alias("total_work_count"))
    kind = tables["links"].schema["professor_id"].dataType
    return whole.select("query_id", F.col("professor_id").cast(kind).alias("professor_id"), F.round(scoring.discounted_sum(F.col("best"), work_limit), 4).alias("score"), "total_work_count")


def ranked_works(scored: DataFrame, prepared: DataFrame, people: DataFrame, links: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Works of each searchable person, one for each title, best first (``place``
    from 1).  Of one title a published version stays before a preprint, then the
    better score, the longer title, the smaller id.  ``chosen``: only people and queries
    in (query_id, professor_id)."""
    who = searchable(people).select("professor_id")
    about = prepared.select("work_id", "title", "publication_year", "doi", "source_name", "title_key", "preprint")
    theirs = links.select("professor_id", "work_id").distinct().join(who, "professor_id", "left_semi").join(about, "work_id").join(scored.hint("merge"), "work_id")  # its size is guessed from the works', and may be many times that
    if chosen is not None:
        theirs = theirs.join(chosen, ["query_id", "professor_id"], "left_semi")
    title = F.coalesce("title", F.lit(""))
    best = F.max_by(F.struct("work_id", "title", "publication_year", "doi", "source_name", "work_score"), F.struct(~F.col("preprint"), F.col("work_score"), F.char_length(title), -F.col("work_id")))
    one = theirs.groupBy("query_id", "professor_id", "title_key").agg(best.alias("w")).select("query_id", "professor_id", "w.*")
    order = Window.partitionBy("query_id", "professor_id").orderBy(F.desc("work_score"), "work_id")
    return one.withColumn("place", F.row_number().over(order))


def rank_people(ranked: DataFrame, people: DataFrame, universities: DataFrame, result_limit: int | None = 25, work_limit: int = 5) -> DataFrame:
    """People by the discounted sum of their best works, rounded to four places;
    ties go to the smaller id.  ``rank`` counts from 1 within a query."""
    sums = ranked.groupBy("query_id", "professor_id").agg(F.sort_array(F.collect_list(F.when(F.col("place") <= 5, F.col("work_score"))), asc=False).alias("best"), F.count("*").alias("total_work_count"))
    return best_people(sums.select("query_id", "professor_id", F.round(scoring.discounted_sum(F.col("best"), work_limit), 4).alias("score"), "total_work_count"), people, universities, result_limit)


def best_people(sums: DataFrame, people: DataFrame, universities: DataFrame, result_limit: int | None = 25) -> DataFrame:
    """People by (query_id, professor_id, score, total_work_count)."""
    named = sums.join(people.select("professor_id", F.col("name").alias("professor_name"), "university_id"), "professor_id").join(universities.select("university_id", F.col("name").alias("university_name")), "university_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "professor_id")
    out = named.withColumn("rank", F.row_number().over(order))
    return (out if result_limit is None else out.where(F.col("rank") <= result_limit)).select(*HIT, "rank")


def search(tables: dict[str, DataFrame], queries: DataFrame, dim: int = 768, result_limit: int | None = 25, work_limit: int = 5, backend: str = "hash", encoders: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, ranked works) of (query_id, query) rows.

    Where ``tables`` has ``prepared`` and ``profiles``, which ``index`` makes, and there is a
    limit, only works of people who may be among the best are scored, and the ranked works
    are of these people."""
    if "backend" in tables["vectors"].columns:
        tables = tables | {"vectors": tables["vectors"].where(F.col("backend") == backend)}
    prepared = tables["prepared"] if "prepared" in tables else prepare_works(tables["works"], tables["vectors"])
    ready, people, chosen = query_rows(queries, dim, backend, encoders), tables["people"], None
    if "profiles" in tables and result_limit is not None:
        ready = cut(ready)
        who = searchable(people).join(tables["universities"].select("university_id"), "university_id", "left_semi")
        chosen = cut(searchindex.candidates(tables["profiles"], who, ready, result_limit, work_limit))
        asked = tables["links"].join(chosen, "professor_id").groupBy("work_id").agg(F.collect_set("query_id").alias("asked_by"))
        scored = score_works(prepared.join(asked, "work_id"), ready)
    else:
        parts = list(_parts(ready))
        sums = people_sums(tables, parts, result_limit, work_limit)
        scored = _united(sums.sparkSession, (_score_part(prepared, shared) for shared in parts), SCORED)
        return best_people(sums, people, tables["universities"], result_limit), ranked_works(scored, prepared, people, tables["links"])
    ranked = ranked_works(scored, prepared, people, tables["links"], chosen)
    return rank_people(ranked, people, tables["universities"], result_limit, work_limit), ranked


def index(tables: dict[str, DataFrame], backend: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(prepared, profiles): what a search needs of works and of people's works."""
    stored = tables["vectors"]
    prepared = prepare_works(tables["works"], stored.where(F.col("backend") == backend) if "backend" in stored.columns else stored)
    return prepared, searchindex.profiles(prepared, tables["links"])


def work_window(ranked: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A person's works from ``offset`` on, at most ``limit``."""
    out = ranked.where(F.col("place") > offset)
    return out if limit is None else out.where(F.col("place") <= offset + limit)


def facets(hits: DataFrame, people: DataFrame, matches: DataFrame | None = None, university_id: int | None = None, department_type: str | None = None, verification_status: str | None = None, match_status: str | None = None) -> DataFrame:
    """Hits of people with these properties.  It filters what a search returned, so
    it can leave fewer than the search's limit."""
    allowed = people
    for column, value in (("university_id", university_id), ("department_type", department_type), ("verification_status", verification_status)):
        if value is not None:
            allowed = allowed.where(F.col(column) == value)
    if match_status is not None:
        allowed = allowed.join(matches.where(F.col("match_status") == match_status), "professor_id", "left_semi")
    return hits.join(allowed, "professor_id", "left_semi")
