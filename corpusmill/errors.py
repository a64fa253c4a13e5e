"""Errors by kind, each with a title and the status a service would answer with; messages name rules, never content."""

from __future__ import annotations


class CorpusError(Exception):
    title, status = "Error", 500

    def problem(self) -> dict[str, object]:
        """The error as a problem document."""
        return {"title": self.title, "status": self.status, "detail": str(self)}


class InvalidRequest(CorpusError, ValueError):
    title, status = "Invalid Request", 400


class NotPublic(InvalidRequest):
    title, status = "Not Public", 403


class NotEmbedded(CorpusError, LookupError):
    title, status = "Not Embedded", 409


class RunConflict(CorpusError, RuntimeError):
    title, status = "Run Conflict", 409


class BrokenStore(CorpusError, ValueError):
    title, status = "Broken Store", 500
