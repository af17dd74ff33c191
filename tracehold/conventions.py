"""Names and limits the telemetry contract fixes.

Everything a sender, a store or a report must agree on is here, so no operator hard-wires a name.
``Conventions`` may be replaced as a whole to read telemetry that follows another contract.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: attribute and span names the senders write, in the contract's order. ---------
RUN_SPAN = "ynh.run"
RUN_COST = "ynh.run.cost_usd"
RUN_OUTCOME = "ynh.run.outcome"
RESPONSE_MODEL = "gen_ai.response.model"
INPUT_TOKENS = "gen_ai.usage.input_tokens"
OUTPUT_TOKENS = "gen_ai.usage.output_tokens"
EVENT_NAME = "event.name"
USER_NAME = "user.name"
SERVICE_NAME = "service.name"
SERVICE_VERSION = "service.version"
LABEL_PREFIX = "ynh.label."
STAMP_PREFIX = "ynr."
PROVENANCE = "ynr.provenance"
PROVENANCE_WARNING = "ynr.provenance.warning"
COLLECTOR_ID = "ynr.collector.id"
COLLECTOR_INSTANCE = "ynr.collector.instance"
RECEIVED_AT = "ynr.received_at"
REGISTRY_MARK = "ynr.registry"
CARDINALITY = "ynr.cardinality"
LANE = "ynf.lane"
LANE_HARNESS = "ynf.lane.harness"
LANE_FOCUS = "ynf.lane.focus"
ITEM_KEY = "ynf.item.key"
STEP_ID = "ynf.step.id"
RUN_ID = "ynf.run.id"

# Promoted columns: the first key present wins, the resource before the record.
PROMOTED: dict[str, tuple[str, ...]] = {
    "service": (SERVICE_NAME,),
    "item_key": (ITEM_KEY,),
    "step_id": (STEP_ID,),
    "run_id": (RUN_ID,),
    "lane": (LANE,),
    "harness": (LANE_HARNESS, "ynh.harness.name"),
    "focus": (LANE_FOCUS, "ynh.run.focus"),
    "repo": ("ynf.repo", "vcs.repository.url.full"),
    "outcome": ("ynf.outcome", RUN_OUTCOME, "ynm.outcome"),
    "actor": (USER_NAME,),
    "model": (RESPONSE_MODEL, "gen_ai.request.model"),
    "provenance": (PROVENANCE,),
    "collector_id": (COLLECTOR_ID,),
    "collector_instance": (COLLECTOR_INSTANCE,),
    "received_at": (RECEIVED_AT,),
}

# Attributes dropped wherever they appear.
STRIPPED = (
    "user.email", "user.full_name", "cwd", "host.name", "host.id", "host.ip", "host.mac",
    "process.owner", "process.command", "process.command_line", "process.command_args",
    "process.executable.path", "tool_input", "tool_parameters",
)
# Attributes pseudonymised with a key, or dropped without one.
ACCOUNT_IDS = ("user.id", "user.account_uuid", "user.account_id", "organization.id")
ACCOUNT_KEY_LABEL = "ynr relay key id"

OUTCOME_GOOD = ("converged", "completed", "ok", "accepted", "claimed")
OUTCOME_WARN = ("budget", "stuck", "held", "deduplicated", "aborted")
OUTCOME_BAD = ("failed", "error", "tamper", "operator_error", "lost", "rejected")

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\z"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
ULID = r"^[0-9A-HJKMNP-TV-Z]{26}\z"
HEX_ID = r"^(0x)?[0-9a-fA-F]{16,}\z"
ITEM_LIKE = r"^(item/\S+|[A-Z][A-Z0-9]+-\d+|\S+/\S+#\d+)\z"
USABLE_NAME = r"^[A-Za-z0-9_.:-]{1,128}\z"
LABEL_KEY = r"^[a-z][a-z0-9_.-]{0,31}\z"
LABEL_VALUE = r"^[A-Za-z0-9._#-][A-Za-z0-9._/#-]{0,63}\z"
WRITER_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"
BATCH_KEY = (r"^(traces|logs|metrics)/(\d{4})/(\d{2})/(\d{2})/(\d{2})/([a-z0-9][a-z0-9._-]{0,62})/"
             r"([0-9A-HJKMNP-TV-Z]{26})_([A-Za-z0-9._~-]+-\d+-\d+)\.jsonl\.gz\z")
PART_KEY = (r"^compacted/(traces|logs|metrics)/(\d{4})/(\d{2})/(\d{2})/(\d{2})/"
            r"(part-[1-9]\d{0,8}\.parquet|_manifest-[1-9]\d{0,8}\.json)\z")
INDEX_KEY = r"^index/items/(\d{4})/(\d{2})/(\d{2})\.parquet\z"
DAILY_KEY = r"^rollups/(runs|metrics)/daily/(\d{4})-(\d{2})-(\d{2})\.parquet\z"
MONTHLY_KEY = r"^rollups/(runs|metrics)/monthly/(\d{4})-(\d{2})\.parquet\z"
# The same as the store writes it: folders that name their hour or day.
STORE_PART_KEY = r"^compacted/signal=(traces|logs|metrics)/hour=(\d{4})-(\d{2})-(\d{2})-(\d{2})/n=([1-9]\d*)/[^/]+\.parquet\z"
STORE_INDEX_KEY = r"^index/items/day=(\d{4})-(\d{2})-(\d{2})/[^/]+\.parquet\z"
STORE_DAILY_KEY = r"^rollups/(runs|metrics)/daily/day=(\d{4})-(\d{2})-(\d{2})/[^/]+\.parquet\z"
STORE_MONTHLY_KEY = r"^rollups/(runs|metrics)/monthly/day=(\d{4})-(\d{2})-01/[^/]+\.parquet\z"
REGISTRY_KEY = (r"^registries/([a-z0-9][a-z0-9._-]{0,62})/([a-z0-9][a-z0-9_-]{0,31})/"
                r"([A-Za-z0-9][A-Za-z0-9._~-]{0,63})/([0-9a-f]{64})\.json\z")

# Patterns end with \z, the end of the text; $ would also match before a last newline.
ERASED = "(erased)"
BY_HAND = "(by hand)"
NO_OUTCOME = "(none)"
NO_MODEL = "(unknown)"
UNUSABLE = "(unusable name)"
NO_MANIFEST = "no-manifest"
BAD_MANIFEST = "bad-manifest"
OVER_BUDGET = "over-budget"
# --- End of fixed values. -----------------------------------------------------------------------

SIGNALS = ("traces", "logs", "metrics")
TABLES = {"traces": "spans", "logs": "logs", "metrics": "metric_points"}
RESOURCE_COLUMN = {"traces": "resourceSpans", "logs": "resourceLogs", "metrics": "resourceMetrics"}
INDEXED_SIGNALS = ("traces", "logs")

SCHEMA_VERSION = 2
LONG_RANGE_DAYS = 7
MAX_LINE_BYTES = 4 << 20
MAX_OBJECT_BYTES = 16 << 20
MAX_MANIFEST_BYTES = 64 << 10
MAX_UNKNOWN_NAMES = 1000
MAX_VENDOR_NAMES = 256
MAX_NAME_CHARS = 128
DEFAULT_RUN_BUDGET = 64 << 20
MAX_TREE_DEPTH = 64
MAX_NESTING = 6
NEWEST = 200
EVIDENCE_ROWS = 6


@dataclass(frozen=True)
class Conventions:
    """The names an engine reads by; the defaults are the contract above."""

    run_span: str = RUN_SPAN
    run_cost: str = RUN_COST
    input_tokens: str = INPUT_TOKENS
    output_tokens: str = OUTPUT_TOKENS
    label_prefix: str = LABEL_PREFIX
    stamp_prefix: str = STAMP_PREFIX
    # Stamped per line read, so they differ between two deliveries of one record.
    transport: tuple[str, ...] = (RECEIVED_AT, COLLECTOR_INSTANCE)
    promoted: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PROMOTED))


DEFAULT = Conventions()
