"""Versions of a dataset: generations, staging, publishing, snapshots, delivery, caches."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from ..functions.scalars import fnv1a

#: What a role may do with a dataset.
ROLES = {"builder": {"read", "write", "metadata", "build"}, "owner": {"read", "write", "metadata"}, "executor": {"read"}}
#: Cache bounds in bytes.
LEAST_CACHE, MOST_CACHE = 512 << 20, 2 << 30


class Stale(RuntimeError):
    """A client's snapshot is no longer the published one."""


@dataclass(frozen=True)
class Service:
    """Generations of a dataset's parts, and which one is active and staged."""

    canonical: int = 1
    plan: int = 1
    pack: int = 1
    epoch: int = 1
    active: int = 1
    staged: int = 0
    append_only: bool = True
    mode: str = "owner_hosted"


def require(role: str, action: str) -> None:
    if action not in ROLES[role]:
        raise PermissionError(f"the role {role} may not {action}")


def stage(s: Service) -> Service:
    """The next generation, staged: what is active stays so."""
    if not s.append_only:
        raise ValueError("only an append-only dataset can be staged")
    n = max(s.canonical, s.plan, s.pack, s.active, s.staged) + 1
    return replace(s, canonical=n, plan=n, pack=n, staged=n)


def publish(current: Service, staged: Service) -> Service:
    """The staged generation made active, under a new epoch."""
    if not staged.staged or staged.staged < current.active:
        raise ValueError("nothing newer than what is active is staged")
    return replace(staged, active=staged.staged, epoch=max(current.epoch, staged.epoch) + 1)


@dataclass(frozen=True)
class Snapshot:
    """A dataset's metadata at one time. Its id depends on all of it but the path."""

    path: str
    summary: dict
    service: Service

    @property
    def id(self) -> int:
        return fnv1a(json.dumps({"summary": self.summary, "service": asdict(self.service)}, sort_keys=True).encode())

    def ref(self) -> dict:
        """What a client keeps to show which version it knows."""
        s = self.service
        return {"snapshot": self.id, "canonical_generation": s.canonical, "plan_generation": s.plan, "pack_generation": s.pack, "service_epoch": s.epoch}

    def check(self, ref: dict) -> None:
        """Stale, with the name of the first generation that differs."""
        own = self.ref()
        for k in ("canonical_generation", "plan_generation", "pack_generation", "service_epoch", "snapshot"):
            if ref.get(k) != own[k]:
                raise Stale(f"{k}: the client has {ref.get(k)}, the owner {own[k]}")

    def delivery(self, ref: dict, shard: int) -> str:
        """Where the pack of a shard lies, for a client that is up to date."""
        self.check(ref)
        if not 0 <= shard < int(self.summary.get("shards", 0)):
            raise IndexError(f"there is no shard {shard}")
        s = self.service
        return f"packs/plan.{s.plan}-pack.{s.pack}-epoch.{s.epoch}/shard.{shard}"

    def dumps(self) -> str:
        return json.dumps({"path": self.path, "summary": self.summary, "service": asdict(self.service), "id": self.id}, sort_keys=True)


def loads(text: str) -> Snapshot:
    """A snapshot of dumps(), whose id must still hold."""
    x = json.loads(text)
    s = Snapshot(x["path"], x["summary"], Service(**x["service"]))
    if s.id != x["id"]:
        raise ValueError("the snapshot isn't what its id says")
    return s


def cache_budget(total: int, free_disk: int) -> int:
    """Bytes for packs on disk: all of them, or half of what is free."""
    return min(total, free_disk // 2)


def memory_budget(free: int) -> int:
    return max(LEAST_CACHE, min(free // 4, MOST_CACHE))


@dataclass
class Entry:
    size: int
    used: int = 0
    last: int = 0
    pinned: bool = False


class PackCache:
    """Which packs stay: beyond the budget, the oldest, largest and least used go first; pinned ones and the newest never."""

    def __init__(self, budget: int):
        self.budget, self.clock, self.entries = budget, 0, {}

    def score(self, e: Entry) -> float:
        return (self.clock - e.last + 1) * (e.size + 1) / (e.used + 1)

    def load(self, key, size: int) -> list:
        """Notes a use, and returns what has to go for it."""
        self.clock += 1
        e = self.entries.setdefault(key, Entry(size))
        e.size, e.used, e.last = size, e.used + 1, self.clock
        out = []
        while sum(x.size for x in self.entries.values()) > self.budget:
            free = [k for k, x in self.entries.items() if k != key and not x.pinned]
            if not free:
                break
            worst = max(free, key=lambda k: self.score(self.entries[k]))
            del self.entries[worst]
            out.append(worst)
        return out

    def pin(self, key, on: bool = True) -> None:
        self.entries[key].pinned = on

    def evict(self, key) -> bool:
        return not self.entries[key].pinned and bool(self.entries.pop(key))

    def invalidate(self) -> None:
        self.entries.clear()


def fingerprint(path: str, size: int, modified: int, family: str, counts: Iterable[int], schema: int) -> str:
    """The name of a cache folder for a dataset as it is now."""
    return f"{fnv1a(json.dumps([path, size, modified, family, [*counts], schema]).encode()):016x}"
