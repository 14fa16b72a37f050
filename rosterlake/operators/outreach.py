"""A first e-mail to a person, drafted from their works.

The text is made by a backend: ``Echo`` returns the prompt, ``Template`` fills a
form.  Services of model vendors are left to the caller, who passes an object with
``complete(system, user)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .inspect import recent_works

ABSTRACT_CHARS, PAPERS = 900, 2
RULES = (
    "Write one e-mail from an applicant to a possible supervisor, 130 to 170 words, plain text.",
    "Start from one fact of a paper given below; say in a sentence how the applicant's interest fits; ask whether the group takes students and offer documents.",
    "Use nothing that is not given.",
)


class Backend(Protocol):
    name: str

    def complete(self, system: str, user: str) -> str: ...


@dataclass
class Applicant:
    interest: str
    name: str = ""
    background: str = ""
    stage: str = "PhD applicant"


@dataclass
class Draft:
    professor_id: int
    professor_name: str
    university_name: str
    backend: str
    body: str
    works: list[dict] = field(default_factory=list)


class Echo:
    name = "echo"

    def complete(self, system: str, user: str) -> str:
        return f"[system]\n{system}\n\n[user]\n{user}"


class Template:
    name = "fake"

    def complete(self, system: str, user: str) -> str:
        held = dict(line.split(": ", 1) for line in user.splitlines() if ": " in line)
        last = (held.get("Professor name") or "[Last name]").split()[-1]
        interest = held.get("Applicant interest") or "your research"
        return f'Subject: Prospective student: {interest}\n\nDear Professor {last},\n\nI read "{held.get("Paper 1 title", "")}" and work on {interest}. Does your group take students for the coming cycle? I can send a CV and a research statement.\n\nBest regards,\n{held.get("Applicant name") or "[Your name]"}\n'


def backend(name: str) -> Backend:
    found = {b.name: b for b in (Echo, Template)}
    if name not in found:
        raise ValueError(f"no backend {name}; there are {', '.join(found)}, or pass your own")
    return found[name]()


def context(professor_id: int, people: DataFrame, universities: DataFrame, links: DataFrame, works: DataFrame, papers: int = PAPERS) -> DataFrame:
    """The person's newest works, with name and university; one row a work."""
    own = links.where(F.col("professor_id") == professor_id)
    newest = recent_works(own, works, papers, by="citations").select("professor_id", "place", "work_id", "title", "publication_year", text.truncate(F.col("abstract"), ABSTRACT_CHARS).alias("abstract"))
    who = people.where(F.col("professor_id") == professor_id).join(universities.select("university_id", F.col("name").alias("university_name")), "university_id")
    return who.select("professor_id", "name", "title", "university_name").withColumnRenamed("title", "job").join(newest, "professor_id", "left").orderBy("place")


def prompts(people: DataFrame, universities: DataFrame, links: DataFrame, works: DataFrame, applicant: Applicant, papers: int = PAPERS) -> DataFrame:
    """(professor_id, professor_name, university_name, prompt, works) of all people who have
    works: what a backend is told of each, their newest works first."""
    if not applicant.interest.strip():
        raise ValueError("an applicant states an interest")
    newest = recent_works(links, works, papers, by="citations")
    line = lambda what, c: F.concat(F.lit("Paper "), F.col("place").cast("string"), F.lit(f" {what}: "), c)
    told = F.concat_ws("\n", line("title", F.coalesce("title", F.lit(""))), line("year", F.coalesce(F.nullif(F.col("publication_year"), F.lit(0)).cast("string"), F.lit("unknown"))), line("abstract", text.truncate(F.col("abstract"), ABSTRACT_CHARS)))
    own = newest.groupBy("professor_id").agg(F.sort_array(F.collect_list(F.struct("place", "work_id", "title", told.alias("told")))).alias("w"))
    who = people.select("professor_id", F.col("name").alias("professor_name"), "title", "university_id").join(universities.select("university_id", F.col("name").alias("university_name")), "university_id")
    me = "\n".join([f"Applicant name: {applicant.name}", f"Applicant interest: {applicant.interest}", f"Applicant background: {applicant.background}", f"Applicant stage: {applicant.stage}"])
    head = [F.concat(F.lit(label), F.coalesce(c, F.lit(""))) for label, c in (("Professor name: ", F.col("professor_name")), ("Professor title: ", F.col("title")), ("University: ", F.col("university_name")))]
    prompt = F.concat_ws("\n", *head, F.array_join(F.transform("w", lambda w: w["told"]), "\n"), F.lit(me))
    return who.join(own, "professor_id").select("professor_id", "professor_name", "university_name", prompt.alias("prompt"), F.transform("w", lambda w: F.struct(w["work_id"].alias("work_id"), w["title"].alias("title"))).alias("works"))


def drafts(asked: DataFrame, make: Callable[[], Backend]) -> DataFrame:
    """(professor_id, backend, body) for each row of ``prompts``; ``make`` gives a task its
    backend."""
    rules = "\n".join(RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = None
        for batch in batches:
            by = by or make()
            bodies = [by.complete(rules, p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([by.name] * len(bodies), pa.string()), pa.array(bodies, pa.string())], names=["professor_id", "backend", "body"])

    return asked.select(F.col("professor_id").cast("bigint").alias("professor_id"), "prompt").mapInArrow(run, "professor_id bigint, backend string, body string")


def draft(professor_id: int, applicant: Applicant, tables: dict[str, DataFrame], by: Backend, papers: int = PAPERS) -> Draft:
    """A draft for one person."""
    one = lambda t: t.where(F.col("professor_id") == professor_id)
    found = prompts(one(tables["people"]), tables["universities"], one(tables["links"]), tables["works"], applicant, papers).take(1)
    if not found:
        raise LookupError("no such person, or none with works to write about")
    r = found[0]
    return Draft(professor_id, r["professor_name"], r["university_name"], by.name, by.complete("\n".join(RULES), r["prompt"]), [w.asDict() for w in r["works"]])
