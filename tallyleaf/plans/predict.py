"""Answers of extraction systems as records, partition by partition, and runs that can be resumed."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from importlib.metadata import entry_points
from typing import Any, Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.functions import answers
from tallyleaf.operators import dialects, schemas, summaries
from tallyleaf.sources import manifest, runs, tables

from . import grade

#: Documents that a task asks for at a time, and seconds that one may take.
WORKERS, TIMEOUT = 4, 1_800.0
RECORD = "doc_id string, sent string, raw string, error_type string, error_status int, error_message string"


class SystemFailed(Exception):
    """A failure of the system on one document; anything else stops the run."""

    def __init__(self, message: str, kind: str = "system", status: int | None = None):
        super().__init__(message)
        self.kind, self.status = kind, status


class DialectError(SystemFailed):
    """A schema that a system's dialect can't express: the document fails for good, without a call."""

    def __init__(self, message: str):
        super().__init__(message, "dialect")


def unreachable(what: str, error: BaseException) -> SystemFailed:
    """The failure for a request that got no answer: timed out, or unreachable."""
    late = isinstance(error, TimeoutError) or isinstance(getattr(error, "reason", None), TimeoutError)
    return SystemFailed(f"{what}: {type(error).__name__}: {error}", "timeout" if late else "unreachable")


class Extractor(Protocol):
    """A system: its dialect, where its answers have the extraction, and the call itself."""

    dialect: str
    reader: str

    def extract(self, doc_path: str, schema: Any) -> Any: ...


@dataclass
class Echo:
    """Answers with what it was given for each path; for tests and rehearsals."""

    known: dict[str, Any]
    dialect: str = "identity"
    reader: str = "plain"

    def extract(self, doc_path: str, schema: Any) -> Any:
        if doc_path not in self.known:
            raise SystemFailed(f"nothing is known of {doc_path}", "unreachable")
        return {"extraction": self.known[doc_path]}


#: Systems by name: what makes one from its options. Packages add theirs as entry points of this group.
PLUGINS = "tallyleaf.systems"
SYSTEMS: dict[str, Callable[[dict], Extractor]] = {"echo": lambda options: Echo(options.get("known", {}), options.get("dialect", "identity"), options.get("reader", "plain"))}


def systems() -> dict[str, Callable[[dict], Extractor]]:
    """All systems that can be named here; built-in ones can't be replaced."""
    return {p.name: (lambda options, p=p: p.load()(options)) for p in entry_points(group=PLUGINS)} | SYSTEMS


def system(name: str, options: dict | None = None) -> Extractor:
    """A system by name; what follows a slash is its model."""
    base, _, model = name.partition("/")
    known = systems()
    if base not in known:
        raise ValueError(f"no system is named {base!r}; there are: {', '.join(sorted(known))}")
    return known[base]((options or {}) | ({"model": model} if model else {}))


def analyzer_name(prefix: str, **parts: Any) -> str:
    """A name that says all that a stored analyzer is made of: it changes with any part."""
    spelled = json.dumps(parts, sort_keys=True)
    return f"{prefix}-{hashlib.sha256(spelled.encode()).hexdigest()[:16]}"


def job_payload(document: str, schema: dict, model: str, prompt: str = "", tables_by: str = "accurate") -> dict:
    """A request for a deep extraction as a job: the document, what is wanted of it, and how."""
    # The format of the request.
    payload = {
        "async": {"priority": False},
        "input": document,
        "parsing": {"enhance": {"agentic": [{"scope": "table", "mode": tables_by}]}},
        "instructions": {"schema": schema},
        "settings": {"deep_extract": True, "citations": {"enabled": False}, "alpha": {"deep_extract_model": model}},
    }
    if prompt:
        payload["instructions"]["system_prompt"] = prompt
    return payload


class Journal:
    """Answers of one call, a file for each document, so that a task that is run again doesn't ask again."""

    def __init__(self, folder: str):
        self.system, self.root = fs.FileSystem.from_uri(folder)

    def _at(self, doc_id: str) -> str:
        name = hashlib.sha256(doc_id.encode()).hexdigest()
        return f"{self.root}/{name[:2]}/{name}.json"

    def read(self, doc_id: str) -> dict | None:
        try:
            with self.system.open_input_stream(self._at(doc_id)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, row: dict) -> None:
        """Under another name first: a file that is there is whole."""
        path = self._at(row["doc_id"])
        self.system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        made = f"{path}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(made) as f:
            f.write(json.dumps(row).encode())
        self.system.move(made, path)


def _asked(system: Extractor, r: dict, timeout: float | None) -> dict:
    """The record of one document. What is no failure of the system is raised."""
    row = dict.fromkeys(("sent", "raw", "error_type", "error_status", "error_message")) | {"doc_id": r["doc_id"]}
    try:
        sent = question(r["schema"], system.dialect)
        row["sent"] = json.dumps(sent, ensure_ascii=False)
        row["raw"] = json.dumps(_within(timeout, system.extract, r["doc_path"], sent), ensure_ascii=False)
    except (SystemFailed, TimeoutError, ConnectionError) as e:
        failed = e if isinstance(e, SystemFailed) else unreachable("the system", e)
        row |= {"error_type": failed.kind, "error_status": failed.status, "error_message": str(failed)}
    return row


def _within(seconds: float | None, call: Callable, *given: Any) -> Any:
    """The call's outcome, or TimeoutError; a call that is too late is left to itself, in a thread that doesn't hold up the worker's end."""
    if not seconds:
        return call(*given)
    out: list[tuple[bool, Any]] = []

    def run() -> None:
        try:
            out.append((True, call(*given)))
        except BaseException as e:  # noqa: BLE001
            out.append((False, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"no answer within {seconds:g} seconds")
    fine, found = out[0]
    if not fine:
        raise found
    return found


def records(documents: DataFrame, system: Extractor, journal: str | None = None, workers: int = WORKERS, timeout: float | None = TIMEOUT) -> DataFrame:
    """One record per document (doc_id, doc_path, schema): what was sent, the raw answer, or the error.

    The schema is sent with its conventions stated, in the system's dialect; one that the dialect can't
    express fails the document for good. A task asks for ``workers`` documents at a time, each of which may take
    ``timeout`` seconds (none: any time). Every answer goes to the journal's folder at once; what is there
    isn't asked again, whether a task is run anew or a run that stopped.
    """
    tables.ready(documents.sparkSession)
    fields = pa.schema([(n, pa.int32() if n == "error_status" else pa.string()) for n in ("doc_id", "sent", "raw", "error_type", "error_status", "error_message")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Journal(journal) if journal else None

        def one(r: dict) -> dict:
            row = kept.read(r["doc_id"]) if kept else None
            if row is None:
                row = _asked(system, r, timeout)
                if kept:
                    kept.write(row)
            return row

        with ThreadPoolExecutor(max(1, workers)) as pool:
            for batch in batches:
                for low in range(0, batch.num_rows, 16 * max(1, workers)):
                    yield pa.RecordBatch.from_pylist(list(pool.map(one, batch.slice(low, 16 * max(1, workers)).to_pylist())), fields)

    return _finished(documents.select("doc_id", "doc_path", "schema").mapInArrow(run, RECORD))


def question(schema: str, dialect: str) -> Any:
    """A schema as it is sent; DialectError if the dialect has no form for it."""
    try:
        return dialects.DIALECTS[dialect](schemas.stripped(schemas.overlaid(json.loads(schema))))
    except (ValueError, TypeError, AttributeError, RecursionError) as e:
        raise DialectError(f"{dialect}: {type(e).__name__}: {e}") from e


def _finished(made: DataFrame) -> DataFrame:
    """Records with the error as a struct and the cost."""
    error = F.struct(F.col("error_type").alias("type"), F.col("error_status").alias("status"), runs.transient(F.col("error_type"), F.col("error_status")).alias("transient"), F.col("error_message").alias("message"))
    return made.select("doc_id", "sent", "raw", F.when(F.col("error_type").isNotNull(), error).alias("error"), answers.cost(F.col("raw")).alias("cost"))


def predict(documents: DataFrame, system: Extractor, folder: str, retry_failed: bool = False, workers: int = WORKERS, timeout: float | None = TIMEOUT) -> DataFrame:
    """Ask for documents that have no record in the folder (or a failure that may pass), and return all records, the newest of each.

    Every call adds one directory, named by its number, so a run that stopped goes on where it was; answers
    of a call that never came to its end are in its journal, and count.
    """
    spark = documents.sparkSession
    old = existing(spark, folder)
    todo = documents if old is None else runs.pending(documents, old, retry_failed)
    journal = f"{folder}/journal/call-{runs.next_call(old)}"
    runs.add_call(records(todo, system, journal, workers, timeout), f"{folder}/records", old)
    tables.dropped(spark, journal)
    return existing(spark, folder)


def existing(spark, folder: str) -> DataFrame | None:
    """The newest record of each document, or None if there is no run yet."""
    return runs.newest(spark, f"{folder}/records")


def predictions(done: DataFrame, reader: str) -> DataFrame:
    """(doc_id, pred) of records, with what the answer says."""
    return done.select("doc_id", answers.extraction(F.col("raw"), reader)["extraction"].alias("pred"))


def unfinished(docs: DataFrame, partial: bool) -> None:
    """Refuse documents without an answer (failure no_answer), unless the grading is partial."""
    told = docs.where("failure = 'no_answer'").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).first()
    if told.n and not partial:
        raise ValueError(f"it isn't finished: {told.n} documents have no answer, such as {told.first}; --partial grades them as failed")


def with_causes(documents: DataFrame, golds: DataFrame, done: DataFrame, reader: str) -> DataFrame:
    """Documents with gold, pred and failure: no_answer (no record), system (an error), unusable (no JSON object), or null."""
    docs = manifest.with_predictions(manifest.with_golds(documents, golds), predictions(done, reader))
    asked = done.select("doc_id", F.col("error").isNotNull().alias("_failed"))
    cause = F.when(F.col("_failed").isNull(), "no_answer").when(F.col("_failed"), "system").when(F.col("failure").isNotNull(), "unusable")
    return docs.join(asked, "doc_id", "left").withColumn("failure", cause).drop("_failed")


def graded(docs: DataFrame, folder: str, order=False, partial: bool = False, details: bool = True) -> tuple[grade.Graded, DataFrame]:
    """Score documents with gold, pred and failure, and write scores, details, summary and coverage. Failed documents count with 0."""
    unfinished(docs, partial)
    done = grade.grade(docs, order)
    covered = summaries.coverage(docs, partial=partial)
    runs.write_scores(done.scores, folder)
    if details:
        runs.write_details(done.verdicts, docs, folder)
    runs.write_summary(done.summary, folder, covered)
    covered.coalesce(1).write.mode("overwrite").json(f"{folder}/coverage")
    return done, runs.summary_object(done.summary, covered)


def grade_run(documents: DataFrame, golds: DataFrame, done: DataFrame, reader: str, folder: str, order=False, partial: bool = False, details: bool = True) -> grade.Graded:
    """Score all documents of a run. One that isn't finished is refused unless partial: then documents without a record have failed."""
    return graded(with_causes(documents, golds, done, reader), folder, order, partial, details)[0]
