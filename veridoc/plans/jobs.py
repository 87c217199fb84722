"""Jobs on disk: queued, running, complete or failed, with their results and files."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from ..sources import readers

PROGRESS = {"queued": 0.0, "running": 0.25, "complete": 1.0, "failed": 1.0}
FILES = {"matrix.csv": "similarity_matrix.csv", "ai-scores.csv": "ai_scores.csv", "report.json": "report.json"}


class JobNotFound(KeyError):
    pass


class JobNotReady(RuntimeError):
    pass


@dataclass
class Job:
    job_id: str
    status: str = "queued"
    num_docs: int = 0
    created_ms: int = 0
    started_ms: int | None = None
    finished_ms: int | None = None
    error: str | None = None

    @property
    def progress(self) -> float:
        return PROGRESS[self.status]

    def elapsed_ms(self, now: int | None = None) -> int:
        start = self.started_ms or self.created_ms
        return (self.finished_ms or now or int(time.time() * 1000)) - start


class JobStore:
    """A folder for each job: input files, status.json, result.json and the outputs."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def folder(self, job_id: str) -> str:
        return os.path.join(self.root, job_id)

    def _save(self, job: Job) -> None:
        path = os.path.join(self.folder(job.job_id), "status.json")
        with open(f"{path}.new", "w") as file:
            json.dump(asdict(job), file)
        os.replace(f"{path}.new", path)

    def submit(self, files: Iterable[tuple[str, bytes]]) -> Job:
        files = list(files)
        names = readers.validate_uploads((n, len(b)) for n, b in files)
        job = Job(uuid.uuid4().hex[:12], num_docs=len(files), created_ms=int(time.time() * 1000))
        os.makedirs(os.path.join(self.folder(job.job_id), "input"))
        for name, body in files:
            with open(os.path.join(self.folder(job.job_id), "input", os.path.basename(name.replace("\\", "/"))), "wb") as file:
                file.write(body)
        assert names
        self._save(job)
        return job

    def get(self, job_id: str) -> Job:
        try:
            with open(os.path.join(self.folder(job_id), "status.json")) as file:
                return Job(**json.load(file))
        except FileNotFoundError:
            raise JobNotFound(job_id) from None

    def run(self, job_id: str, analysis: Callable[[str, str], dict]) -> Job:
        """analysis(input folder, output folder) returns the normalised result; its error text is kept."""
        job = self.get(job_id)
        job.status, job.started_ms = "running", int(time.time() * 1000)
        self._save(job)
        try:
            result = analysis(os.path.join(self.folder(job_id), "input"), self.folder(job_id))
            with open(os.path.join(self.folder(job_id), "result.json"), "w") as file:
                json.dump(result, file)
            job.status = "complete"
        except Exception as error:
            job.status, job.error = "failed", str(error)
        job.finished_ms = int(time.time() * 1000)
        self._save(job)
        return job

    def result(self, job_id: str) -> dict:
        if self.get(job_id).status != "complete":
            raise JobNotReady(job_id)
        with open(os.path.join(self.folder(job_id), "result.json")) as file:
            return json.load(file)

    def file(self, job_id: str, name: str) -> str:
        path = os.path.join(self.folder(job_id), FILES[name])
        if not os.path.exists(path):
            raise JobNotFound(f"{job_id}/{name}")
        return path
