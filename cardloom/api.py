"""One garden store behind the operations a host calls: read, search, context, related, browse, export, write, maintain.

Every read is a DataFrame over the record table; every write is a batch of mutations with an idempotency key. A scope (tenant, owner,
mounts) is applied to each read and stamped on each write; it is never taken from rows.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions import text as X
from cardloom.operators import lexical, lifecycle, maintenance, related, selection
from cardloom.operators.change_feed import RecordTable
from cardloom.sources.delete_vectors import RevisionConflict

FEED = (
    "feed_seq bigint, tenant string, owner string, op string, mount string, record_id string, target_ids array<string>, "
    "card struct<id:string,summary:string,content:string,bucket:string,importance:double,source:string>, changes map<string,string>, "
    "to_mount string, reason string, requested_by string, idempotency_key string, expected_revision string, written_at timestamp"
)
#: Fields that an update may not touch.
FIXED_FIELDS = ("id", "tenant", "owner", "mount", "source", "created_at", "updated_at", "archived", "archive_reason", "superseded_by", "revision", "idempotency_key")
ERRORS = ("invalid_request", "forbidden_mount", "not_found", "revision_conflict", "key_conflict", "unsupported_operation")


class RequestError(ValueError):
    """A request that is refused; its text is one of ERRORS, with a detail."""


@dataclass(frozen=True)
class Scope:
    tenant: str
    owner: str
    mounts: tuple[str, ...] = ("agent-private",)
    actor: str | None = None

    def allow(self, mount: str) -> str:
        if mount not in (self.mounts or ("agent-private",)):
            raise RequestError(f"forbidden_mount: {mount}")
        return mount


@dataclass
class Receipt:
    ok: bool
    results: list[dict] = field(default_factory=list)
    error: str | None = None
    revision: str | None = None


class Garden:
    """`clock` is a function without arguments that gives the time of a write: results depend on nothing else outside the table."""

    def __init__(self, spark: SparkSession, path: str | None = None, clock=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)):
        self.spark, self.table, self.clock = spark, RecordTable(spark, path), clock

    # -- reads ------------------------------------------------------------------------------------------------------------
    def cards(self, scope: Scope, states: tuple[str, ...] = ("active",)) -> DataFrame:
        """The scope's cards in the given states; unknown states never come."""
        if not self.table.images.version():
            return self.spark.createDataFrame([], "id string, tenant string, owner string, mount string, summary string, content string, bucket string, importance double, source string, archived boolean, archive_reason string, superseded_by string, revision bigint, idempotency_key string, updated_at timestamp, text string, state string, occurred_ts timestamp, created_ts timestamp, role string")
        rows = self.table.records().withColumnRenamed("record_id", "id").filter((F.col("tenant") == scope.tenant) & (F.col("owner") == scope.owner))
        rows = rows.withColumn("status", F.lit(None).cast("string"))
        rows = lifecycle.scoped(rows, list(scope.mounts), list(states)).drop("status")
        text = X.match_text(None, [F.col("summary"), F.col("content"), F.col("bucket")], [])
        return rows.withColumns({"text": text, "occurred_ts": F.col("updated_at"), "created_ts": F.col("updated_at"), "role": F.lit(None).cast("string")})

    def _asked(self, scope: Scope, query: str) -> DataFrame:
        return self.spark.createDataFrame([("q", scope.owner, query or "")], "qid string, owner string, text string")

    def search(self, scope: Scope, query: str, limit: int = 8) -> DataFrame:
        """(id, rank, score, coverage, matched): no row rather than a weak one. A blank query finds nothing."""
        c = self.cards(scope)
        return lexical.ranked(lexical.evaluate(self._asked(scope, query), c), c, limit).select("id", "rank", "score", "coverage", "matched")

    def context(self, scope: Scope, messages: list[str], cap: int = C.CAP) -> DataFrame:
        """Cards to bring to mind for the last four messages, with the seat each one has."""
        query = "\n".join([m for m in messages if m and m.strip()][-4:])
        c = self.cards(scope)
        ranked = lexical.ranked(lexical.evaluate(self._asked(scope, query), c), c, None)
        return selection.seats(ranked.join(c.select("id", "role", "created_ts"), "id"), cap).drop("qid")

    def related(self, scope: Scope, ids: list[str], cap: int = C.RELATED_CAP) -> DataFrame:
        """Neighbours of the given cards one hop away: what they superseded."""
        c = self.cards(scope, ("active", "superseded"))
        back = c.filter("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.collect_set("id").alias("supersedes"))
        none = F.expr("cast(array() as array<string>)")
        full = c.join(back, "id", "left").withColumns({"scope": F.col("owner"), "threads": none, "anchor_memory_ids": none, "status": F.col("state")})
        return related.one_hop(full.filter(F.col("id").isin(*ids)).withColumn("set_id", F.lit("s")), full, cap).drop("set_id")

    def browse(self, scope: Scope, cursor: str | None = None, limit: int = C.PAGE_DEFAULT, states: tuple[str, ...] = ("active",)) -> DataFrame:
        at = self.spark.createDataFrame([(scope.owner, cursor)], "owner string, cursor string")
        rows = lifecycle.page(self.cards(scope, states), at, limit)
        return rows.select("id", "summary", "content", F.col("bucket").alias("group_label"), "state", "n", "has_more").orderBy("n")

    def export(self, scope: Scope) -> tuple[DataFrame, dict]:
        """All cards of a scope, and how many there are, archived and superseded."""
        rows = self.cards(scope, ("active", "archived", "superseded"))
        counts = rows.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "archived").alias("archived"), F.count_if(F.col("state") == "superseded").alias("superseded")).first()
        return rows, counts.asDict()

    def read(self, scope: Scope, record_id: str, cursor: str | None = None, limit: int = C.CHUNK_DEFAULT) -> dict:
        """A part of one record's JSON; the cursor pins the version it was begun on."""
        row = self.cards(scope, ("active", "archived", "superseded")).filter(F.col("id") == record_id).drop("text", "occurred_ts", "created_ts", "role").first()
        if row is None:
            raise RequestError(f"not_found: {record_id}")
        body = json.dumps(row.asDict(), default=str, ensure_ascii=False, sort_keys=True)
        digest, start = hashlib.sha256(body.encode()).hexdigest(), 0
        if cursor:
            seen, start = json.loads(base64.b64decode(cursor))
            if seen != digest:
                raise RequestError("revision_conflict: the record changed while it was read")
        end = start + max(1, min(C.CHUNK_MOST, limit))
        more = base64.b64encode(json.dumps([digest, end]).encode()).decode() if end < len(body) else None
        return {"id": record_id, "text": body[start:end], "cursor": more}

    def needs_maintenance(self, scope: Scope, last_signature: str | None = None, last_seed_count: int = 0, min_new: int = C.MIN_NEW_CARDS) -> DataFrame:
        rows = self.cards(scope, ("active", "archived", "superseded")).withColumns({"status": F.col("state"), "created_at": F.col("updated_at"), "occurred_at": F.lit(None).cast("string")})
        ledger = self.spark.createDataFrame([(scope.owner, last_signature, last_seed_count)], "scope string, last_signature string, last_seed_count bigint")
        return maintenance.verdicts(maintenance.shapes(rows), ledger, min_new)

    # -- writes -----------------------------------------------------------------------------------------------------------
    def revision(self) -> str:
        """The revision that `apply` may be told to expect: any committed write changes it."""
        return str(self.table.images.version())

    def apply(self, scope: Scope, mutations: list[dict], key: str, expected_revision: str | None = None, maintenance: dict | None = None) -> Receipt:
        """Apply mutations in order, each against the revision it names or, if it names none, the present one.

        The batch has one key: repeated with the same content it gives the first receipt, with other content a key_conflict; that is looked
        at before anything else. All or nothing is applied: a mutation that is refused, a record at another revision than expected, or a
        store at another revision than `expected_revision` refuse the batch. Later mutations see what earlier ones did. A supersede retires
        all of its targets; an add without id gets a fresh one, and an add may follow a delete. `maintenance` is a ledger to be stored with
        the batch.
        """
        said = {"mutations": mutations, "maintenance": maintenance}
        digest = hashlib.sha256(json.dumps(said, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()[:32]
        seen = self._receipt(scope, key)
        if seen is not None:
            return Receipt(True, seen["results"], revision=seen["revision"]) if seen["digest"] == digest else Receipt(False, error="key_conflict")
        base = self.table.images.manifest()
        if expected_revision is not None and expected_revision != str(base["version"]):
            return Receipt(False, error=f"revision_conflict: expected {expected_revision}, is {base['version']}")
        try:
            rows, results, next_seq = self._judge(scope, mutations, base, digest)
        except RequestError as e:
            if str(e).startswith("forbidden_mount"):
                raise
            return Receipt(False, error=str(e))
        request = {"digest": digest, "results": results, "revision": str(base["version"] + 1), "at": base["version"] + 1, "mark": uuid.uuid4().hex, "maintenance": maintenance}
        try:
            self._put(self._request_path(scope, key), request)
            if maintenance is not None:
                self._put(self._ledger_path(scope, base["version"] + 1, request["mark"]), request)
            self.table.apply(self.spark.createDataFrame(rows, FEED), {"next_seq": next_seq, "mark": request["mark"]}, base)
        except RevisionConflict:
            return Receipt(False, error="revision_conflict: another writer was first")
        return Receipt(True, results, revision=request["revision"])

    def apply_judged(self, scope: Scope, judge, key: str, tries: int = 3) -> Receipt:
        """Apply what `judge` makes of the cards as they stand; if another writer was first it is asked again, with the cards as they are then."""
        for _ in range(tries):
            at = self.revision()
            receipt = self.apply(scope, judge(self.cards(scope)), key, at)
            if receipt.ok or not (receipt.error or "").startswith("revision_conflict"):
                break
        return receipt

    def ledger(self, scope: Scope) -> dict | None:
        """The maintenance ledger stored with the newest batch of the scope that had one."""
        fs, at = self.table.images._fs, self.table.images._at
        folder = at(self._ledger_path(scope, None, ""))
        if not fs.exists(folder):
            return None
        for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName(), reverse=True):
            request = self._get(f"{self._ledger_path(scope, None, '')}/{status.getPath().getName()}")
            if request is not None and self._committed(request):
                return request["maintenance"]
        return None

    def _judge(self, scope: Scope, mutations: list[dict], base: dict, digest: str) -> tuple[list[tuple], list[dict], int]:
        """The feed rows and results of a batch, checked one after another on the touched records alone; RequestError for a refusal."""
        images, extra, now = self.table.images, base["extra"], self.clock()
        first = next_seq = extra.get("next_seq", 1)
        supplied = [(m.get("card") or {}).get("id") for m in mutations]
        numbers = [int(n[2:]) for n in supplied if n and re.fullmatch(r"m_\d{1,15}", n)]
        next_seq = max([next_seq, *(n + 1 for n in numbers)])
        fresh = [f"m_{next_seq + k}" for k in range(len(mutations) + len(numbers))]
        ids = sorted({i for m in mutations for i in self._touched(m)} | set(fresh))
        found = {}
        places = images.lookup(ids, base) if base["index"] else None
        if places is not None:
            places = places.cache()
            live = images.images_at(places, base).select("record_", "tenant", "owner", F.coalesce("mount", F.lit("agent-private")).alias("mount"))
            own = {r.record_: (r.tenant, r.owner, r.mount) for r in live.collect()}
            for r in places.collect():
                found[r.record_] = [r.revision_, not r.deleted_, own.get(r.record_)]
            places.unpersist()
        unused = [i for i in fresh if i not in found]

        def standing(record: str) -> list:
            """[revision, exists] of a record of this scope; one of another scope or mount is as good as absent."""
            at = found.get(record)
            if at is None or not at[1] or at[2][:2] != (scope.tenant, scope.owner):
                raise RequestError(f"not_found: {record}")
            scope.allow(at[2][2])
            return at

        rows, results, seq = [], [], next_seq + len(fresh)
        for k, m in enumerate(mutations):
            op, card = (m.get("op") or "add").strip().lower(), dict(m.get("card") or {})
            self._check(op, m, card)
            mount = scope.allow(m.get("mount") or scope.mounts[0])
            if op == "promote":
                scope.allow(m["to_mount"])
            if op in ("add", "supersede"):
                card["id"] = (card.get("id") or "").strip() or unused.pop(0)
                at = found.setdefault(card["id"], [0, False, None])
                if at[1] or op == "supersede" and at[0]:
                    raise RequestError(f"invalid_request: {card['id']} exists")
            targets = [] if op in ("add", "no_op") else self._targets(m) if op == "supersede" else [m.get("record_id") or m.get("target_id")]
            for t in targets or [card.get("id")]:
                at = found[t] if op == "add" else None if op == "no_op" else standing(t)
                want = m.get("expected_revision")
                if at is not None and want is not None and str(want) != str(at[0]):
                    raise RequestError(f"revision_conflict: {t} is at {at[0]}, not {want}")
                body = (card["id"], card.get("summary"), card.get("content"), card.get("bucket"), card.get("importance"), card.get("source")) if card else None
                rows.append((seq, scope.tenant, scope.owner, op, mount, None if op in ("add", "supersede") else t, [t] if op == "supersede" else None, body, m.get("changes"), m.get("to_mount"), m.get("reason"), m.get("requested_by") or scope.actor, f"{digest}#{seq}", str(at[0] if at else 0), now))
                seq += 1
                if at is not None:
                    at[0], at[1] = at[0] + 1, op != "delete"
                    at[2] = (scope.tenant, scope.owner, m["to_mount"] if op == "promote" else at[2][2] if at[2] and op != "add" else mount)
            if op == "supersede":
                found[card["id"]] = [1, True, (scope.tenant, scope.owner, mount)]
            done = card["id"] if op in ("add", "supersede") else targets[0] if targets else None
            results.append({"op": op, "id": done, "revision": found[done][0] if done else None, **({"replaced": targets} if op == "supersede" else {})})
        return rows, results, seq

    def _touched(self, m: dict) -> list[str]:
        return [x for x in [m.get("record_id"), m.get("target_id"), *(m.get("target_ids") or []), ((m.get("card") or {}).get("id") or "").strip()] if x]

    def _targets(self, m: dict) -> list[str]:
        """The distinct targets of a supersede; the older single fields count too."""
        return list(dict.fromkeys(t.strip() for t in [m.get("record_id"), m.get("target_id"), *(m.get("target_ids") or [])] if t and t.strip()))

    def _check(self, op: str, m: dict, card: dict) -> None:
        if op not in ("add", "update", "supersede", "archive", "delete", "promote", "no_op"):
            raise RequestError(f"unsupported_operation: {op}")
        if op in ("add", "supersede") and not card.get("summary"):
            raise RequestError("invalid_request: card with summary needed")
        if op == "update" and (not m.get("changes") or set(m["changes"]) & set(FIXED_FIELDS)):
            raise RequestError("invalid_request: changes")
        if op == "delete" and not m.get("requested_by"):
            raise RequestError("invalid_request: requested_by needed")
        if op == "promote" and not m.get("to_mount"):
            raise RequestError("invalid_request: to_mount needed")
        if op == "supersede" and not self._targets(m):
            raise RequestError("invalid_request: target needed")

    # A request is a small file whose name is the hash of its key; it counts once the manifest of its version bears its mark.
    def _request_path(self, scope: Scope, key: str) -> str:
        name = hashlib.sha256(json.dumps([scope.tenant, scope.owner, key]).encode()).hexdigest()
        return f"{self.table.path}/requests/{name[:3]}/{name}.json"

    def _ledger_path(self, scope: Scope, version: int | None, mark: str) -> str:
        name = hashlib.sha256(json.dumps([scope.tenant, scope.owner, scope.mounts[0]]).encode()).hexdigest()
        return f"{self.table.path}/ledgers/{name}" + (f"/{version:012d}-{mark}.json" if version is not None else "")

    def _put(self, path: str, value: dict) -> None:
        stream = self.table.images._fs.create(self.table.images._at(path), True)
        stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        stream.close()

    def _get(self, path: str) -> dict | None:
        fs, at = self.table.images._fs, self.table.images._at(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _committed(self, request: dict) -> bool:
        images = self.table.images
        return request["at"] <= images.version() and images.manifest(request["at"])["extra"].get("mark") == request["mark"]

    def _receipt(self, scope: Scope, key: str) -> dict | None:
        request = self._get(self._request_path(scope, key))
        return request if request is not None and self._committed(request) else None

    def write_one(self, scope: Scope, record_id: str, content: str, key: str, bucket: str | None = None) -> Receipt:
        """Store a text that the user stated: its summary is its first 38 characters, with an ellipsis if it has more than 40."""
        body = content.strip()
        return self.apply(scope, [{"op": "add", "card": {"id": record_id, "summary": body if len(body) <= 40 else body[:38] + "…", "content": body, "bucket": bucket, "source": "curated"}}], key)

    def delete(self, scope: Scope, record_id: str, requested_by: str, key: str) -> Receipt:
        return self.apply(scope, [{"op": "delete", "record_id": record_id, "requested_by": requested_by}], key)

    def promote(self, scope: Scope, record_id: str, to_mount: str, key: str) -> Receipt:
        return self.apply(scope, [{"op": "promote", "record_id": record_id, "to_mount": to_mount}], key)
