"""Who may do what: authorisation scopes and refused capabilities (checked on the driver)."""

from __future__ import annotations

import hashlib
import hmac
import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

# What a scope must say, and capabilities that are refused.
REQUIRED = "case_id purpose legal_basis authorising_party data_subject_categories permitted_operations retention_period_days expiry_date".split()
REFUSED = "biometric_face_recognition facial_recognition biometric_identification bulk_platform_scraping identity_correlation realtime_location_tracking stalking covert_surveillance external_hash_db_query".split()


class ScopeError(ValueError):
    """A scope that can't be relied on."""


class Refused(PermissionError):
    """A capability that is never offered."""


def check_capabilities(names) -> None:
    for name in names:
        if str(name).strip().lower() in REFUSED:
            raise Refused(name)


@dataclass
class Scope:
    case_id: str
    purpose: str
    legal_basis: str
    authorising_party: str
    data_subject_categories: list[str]
    permitted_operations: list[str]
    retention_period_days: int
    expiry_date: str
    disabled_analyzers: list[str] = field(default_factory=list)
    self_audit: bool = False

    def canonical(self) -> bytes:
        own = {k: getattr(self, k) for k in (*REQUIRED, "disabled_analyzers")}
        return json.dumps({k: sorted(v) if isinstance(v, list) else v for k, v in own.items()}, sort_keys=True).encode()

    def digest(self) -> str:
        return hashlib.sha256(self.canonical()).hexdigest()

    def signature(self, secret: str) -> str:
        return hmac.new(secret.encode(), self.canonical(), hashlib.sha256).hexdigest()

    def expired(self, now: datetime | None = None) -> bool:
        end = datetime.fromisoformat(self.expiry_date.replace("Z", "+00:00"))
        return (now or datetime.now(UTC)) > (end if end.tzinfo else end.replace(tzinfo=UTC))

    def permits(self, analyser: str, tier: int) -> bool:
        if analyser in self.disabled_analyzers:
            return False
        return self.self_audit or bool({"all", f"tier{tier}", analyser} & set(self.permitted_operations))


def self_audit() -> Scope:
    """A scope for one's own files; it is made in memory only."""
    return Scope("self-audit", "own files", "consent", "self", ["self"], ["tier1", "tier2", "tier3", "tier4"], 0, "9999-12-31T00:00:00+00:00", [], True)


def load(text: str, secret: str | None = None, now: datetime | None = None) -> Scope:
    """A scope from JSON, with its hash, its signature (if a secret is given) and its expiry checked."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ScopeError(f"no JSON: {e}") from e
    if missing := [k for k in REQUIRED if k not in data]:
        raise ScopeError(f"missing: {', '.join(missing)}")
    if data.get("is_self_audit"):
        raise ScopeError("a file can't declare a self-audit")
    scope = Scope(**{k: data[k] for k in REQUIRED}, disabled_analyzers=data.get("disabled_analyzers", []))
    if data.get("scope_hash") and not hmac.compare_digest(str(data["scope_hash"]), scope.digest()):
        raise ScopeError("the hash differs from the content")
    if secret and not hmac.compare_digest(str(data.get("signature") or ""), scope.signature(secret)):
        raise ScopeError("the signature is wrong")
    if scope.expired(now):
        raise ScopeError(f"expired on {scope.expiry_date}")
    return scope


def dump(scope: Scope, secret: str | None = None) -> str:
    own = {k: getattr(scope, k) for k in (*REQUIRED, "disabled_analyzers")} | {"scope_hash": scope.digest()}
    return json.dumps(own | ({"signature": scope.signature(secret)} if secret else {}), indent=2)
