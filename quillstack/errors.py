"""What can go wrong, in five kinds; each has an exit code of its own for the command line."""

from __future__ import annotations

from datetime import UTC, datetime


class LedgerError(Exception):
    kind, exit_code = "error", 1

    def __init__(self, message: str, details: str = "", migration: str = ""):
        super().__init__(message, details, migration)
        self.message, self.details, self.migration, self.timestamp = message, details, migration, datetime.now(UTC)

    def __str__(self) -> str:
        about = f" (migration: {self.migration})" if self.migration else ""
        return f"[{self.kind}] {self.message}{about}: {self.details}"


class ConnectionFailed(LedgerError):
    kind, exit_code = "connection", 2


class MigrationFailed(LedgerError):
    kind, exit_code = "migration", 3


class ValidationFailed(LedgerError):
    kind, exit_code = "validation", 4


class FileFailed(LedgerError):
    kind, exit_code = "file", 5


class PermissionFailed(LedgerError):
    kind, exit_code = "permission", 6
