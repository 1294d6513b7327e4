"""Progress of scheduled indexing: how far each kind of record has been read, under a lock with fencing tokens.

State is small files.  Their names have numbers, and the store's create-if-absent decides who gets one: a token is one file, made with
its time in it, so a process that ends right after it leaves a lock that goes stale like any other.  A lock that was neither released nor
used for ``stale`` seconds may be taken over; its old holder's token then moves nothing.  Every batch moves the mark, and that is a use.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEGINNING = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Progress:
    def __init__(self, spark: SparkSession, path: str, stale: float = 600, clock: Callable[[], float] = time.time):
        self.path, self.stale, self.clock = path.rstrip("/"), stale, clock
        self.make = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str, what: str) -> list[list[int]]:
        """Numbers in the names of one sort of file, ascending."""
        folder = self.make(f"{self.path}/{kind}")
        if not self.system.exists(folder):
            return []
        names = [s.getPath().getName().split("-") for s in self.system.listStatus(folder)]
        return sorted([int(x) for x in n[1:]] for n in names if n[0] == what)

    def _create(self, kind: str, what: str, *numbers: int, text: str = "") -> bool:
        try:
            out = self.system.create(self._path(kind, what, *numbers), False)
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _path(self, kind: str, what: str, *numbers: int):
        return self.make(f"{self.path}/{kind}/{'-'.join([what, *map(str, numbers)])}")

    def _text(self, kind: str, what: str, *numbers: int) -> str:
        stream = self.system.open(self._path(kind, what, *numbers))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _now(self) -> int:
        return int(self.clock() * 1e6)

    def _used(self, kind: str, token: int) -> int:
        """When a token was made or last used; one whose process ended before it wrote the time has that of its file."""
        made = self._text(kind, "token", token)
        made = int(made) if made else self.system.getFileStatus(self._path(kind, "token", token)).getModificationTime() * 1000
        beats = [n[1] for n in self._names(kind, "beat") if n[0] == token] + [n[3] for n in self._names(kind, "mark") if n[0] == token]
        return max([made, *beats])

    def held(self, kind: str) -> bool:
        """Whether a holder is at work."""
        tokens = self._names(kind, "token")
        return bool(tokens) and tokens[-1] not in self._names(kind, "free") and self._now() - self._used(kind, tokens[-1][0]) < self.stale * 1e6

    def acquire(self, kind: str, behind: tuple[str, ...] = ()) -> int | None:
        """A token, one more than the last; None while another holder is at work, on this kind or on one that it has to wait for."""
        if any(self.held(k) for k in (kind, *behind)):
            return None
        tokens = self._names(kind, "token")
        token = tokens[-1][0] + 1 if tokens else 1
        if not self._create(kind, "token", token, text=str(self._now())):
            return None
        self._tidy(kind, token)
        return token

    def _tidy(self, kind: str, token: int) -> None:
        """Delete what no one asks for any more: files of earlier tokens but the last mark."""
        for what in ("token", "free", "beat", "mark"):
            found = self._names(kind, what)
            for n in found[:-1] if what == "mark" else found:
                if n[0] < token - 1:
                    self.system.delete(self._path(kind, what, *n), False)

    def beat(self, kind: str, token: int) -> None:
        """Use the lock; for steps that may take longer than ``stale``."""
        self._create(kind, "beat", token, self._now())

    def mark(self, kind: str) -> datetime:
        """How far the kind has been read."""
        marks = self._names(kind, "mark")
        return datetime.fromtimestamp(marks[-1][2] / 1e6, timezone.utc) if marks else BEGINNING

    def place(self, kind: str) -> dict:
        """What ``advance`` was told about the last mark."""
        marks = self._names(kind, "mark")
        return json.loads(self._text(kind, "mark", *marks[-1]) or "{}") if marks else {}

    def advance(self, kind: str, token: int, to: datetime, **place) -> bool:
        """Move the mark; False if the token is no longer the last."""
        if self._names(kind, "token")[-1] != [token]:
            return False
        mine = [n[1] for n in self._names(kind, "mark") if n[0] == token]
        return self._create(kind, "mark", token, max(mine, default=-1) + 1, int(to.timestamp() * 1e6), self._now(), text=json.dumps(place))

    def release(self, kind: str, token: int) -> None:
        self._create(kind, "free", token)


def index_changes(
    progress: Progress, kind: str, table: DataFrame, index: Callable[[DataFrame], object], delete: Callable[[DataFrame], object],
    stamp: str = "last_updated_date", key: str = "id", batch: int = 100_000, behind: tuple[str, ...] = (),
) -> int | None:
    """Index the rows of ``table`` changed since the mark, delete those marked ``is_deleted``, in batches by (stamp, key), and move the mark
    behind each.

    How many rows there were; None if another holder is at work.  If a step fails the mark stays behind the last batch, and the next run
    goes on from there.  A mark knows how many rows had its stamp, and a digest of their keys; where rows with that stamp have come
    since, all of that stamp are read again."""
    token = progress.acquire(kind, behind)
    if token is None:
        return None
    at, total = F.struct(F.col(stamp).alias("s"), F.col(key).alias("k")), 0
    gone = F.coalesce(F.col("is_deleted"), F.lit(False)) if "is_deleted" in table.columns else F.lit(False)

    def seen(top: datetime, last) -> dict:
        """Rows with the mark's stamp up to its key."""
        n, digest = table.where((F.col(stamp) == F.lit(top)) & (F.col(key) <= F.lit(last))).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(key))).first()
        return {"key": last, "n": n, "digest": digest}

    def behind_of(top: datetime, last):
        return (F.col(stamp) >= F.lit(top)) & (at > F.struct(F.lit(top).cast("timestamp").alias("s"), F.lit(last).cast(dict(table.dtypes)[key]).alias("k")))

    try:
        top, place = progress.mark(kind), progress.place(kind)
        rest = behind_of(top, place["key"]) if place.get("n") and seen(top, place["key"]) == place else F.col(stamp) >= F.lit(top)
        while True:
            last, n = table.where(rest).select(at.alias("at")).orderBy("at").limit(batch).agg(F.max("at"), F.count(F.lit(1))).first()
            if not n:
                return total
            top = last.s.astimezone(timezone.utc)
            rows = table.where(rest & ~behind_of(top, last.k))
            index(rows.where(~gone))
            progress.beat(kind, token)
            delete(rows.where(gone))
            if not progress.advance(kind, token, top, **seen(top, last.k)):
                raise RuntimeError(f"{kind}: the lock was taken over")
            rest, total = behind_of(top, last.k), total + n
    finally:
        progress.release(kind, token)


def scheduled(progress: Progress, kinds: dict[str, tuple[DataFrame, Callable, Callable]], first: tuple[str, ...] = ("instance", "item")) -> dict[str, int | None]:
    """One round over all kinds, parents before children; a child waits while a parent is at work elsewhere."""
    parents = tuple(k for k in first if k in kinds)
    order = [*parents, *(k for k in kinds if k not in first)]
    return {k: index_changes(progress, k, *kinds[k], behind=() if k in parents else parents) for k in order}
