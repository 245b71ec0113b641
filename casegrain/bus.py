"""Messages in the driver's process: handlers by class, in order of priority; one that fails doesn't stop the others."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime


@dataclass
class Message:
    at: datetime = field(default_factory=lambda: datetime.now(UTC))


@dataclass
class CaseOpened(Message):
    targets: tuple[str, ...] = ()


@dataclass
class CaseAnalysed(Message):
    findings: int = 0


@dataclass
class VerdictGiven(Message):
    sha256: str = ""
    label: str = ""
    risk: str = "LOW"


@dataclass
class PayloadCarved(Message):
    sha256: str = ""
    kind: str = ""
    offset: int = 0
    length: int = 0


class Bus:
    def __init__(self):
        self._handlers: list[tuple[int, int, type, Callable]] = []

    def subscribe(self, kind: type, handler: Callable, priority: int = 100) -> None:
        """Handlers of a class get its subclasses' messages too; lower priorities come first."""
        self._handlers.append((priority, len(self._handlers), kind, handler))
        self._handlers.sort(key=lambda h: h[:2])

    def publish(self, message: Message) -> None:
        for _, _, kind, handler in list(self._handlers):
            if isinstance(message, kind):
                try:
                    handler(message)
                except Exception:
                    logging.getLogger(__name__).exception("a handler of %s failed", kind.__name__)

    def audit_to(self, writer) -> None:
        """Every message into an audit log (casegrain.operators.audit.Writer)."""
        self.subscribe(Message, lambda m: writer.append(type(m).__name__, **{k: str(v) for k, v in vars(m).items()}), priority=0)
