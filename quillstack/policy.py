"""What may run where: production gating and confirmations. `ask` is given, so nothing here reads a terminal by itself."""

from __future__ import annotations

import os
from collections.abc import Callable

from .errors import PermissionFailed

#: Operations that are never run in production, and those that run there after a typed word.
REFUSED, TYPED = {"drop", "reset-database", "reset", "fresh", "refresh"}, {"rollback"}


def in_production(environment: str | None = None, env: dict[str, str] | None = None) -> bool:
    """By the configured environment, or by QUILLSTACK_ENV or else APP_ENV."""
    env = dict(os.environ) if env is None else env
    name = environment if environment is not None else env.get("QUILLSTACK_ENV") or env.get("APP_ENV") or ""
    return name.lower() in ("production", "prod")


class Policy:
    def __init__(self, production: bool = False, ask: Callable[[str], str] | None = None):
        self.production, self.ask = production, ask or (lambda prompt: "")

    def confirm(self, operation: str) -> bool:
        """A `YES` in production, `y` or `yes` elsewhere."""
        if self.production:
            return self.ask(f"PRODUCTION: {operation} can't be undone. Type 'YES' to go on: ") == "YES"
        return self.ask(f"{operation} can't be undone. Go on? (y/N): ").lower() in ("y", "yes")

    def typed(self, operation: str, word: str) -> bool:
        """`YES` in production, the given word elsewhere."""
        need = "YES" if self.production else word
        return self.ask(f"{operation} can't be undone. Type '{need}' to go on: ") == need

    def require(self, operation: str, confirmed: bool = False) -> None:
        """Raises unless the operation may run."""
        if self.production and operation in REFUSED:
            raise PermissionFailed("Not allowed in production", operation)
        if operation in REFUSED | TYPED and not confirmed:
            agreed = self.typed(operation, operation) if self.production or operation in ("drop", "fresh", "reset-database") else self.confirm(operation)
            if not agreed:
                raise PermissionFailed("Not confirmed", operation)
