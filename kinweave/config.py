"""Rules, weights, comparators, probability model and tenant settings: checked once on the driver."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import asdict, dataclass, field, replace

from kinweave.schemas import COMPARISON_LEVELS, EVIDENCE_FIELDS

NHS_SYSTEM = "https://fhir.nhs.uk/Id/nhs-number"
TRACED_TAG = "traced"
GOLD_TAG = "gold"

# Rule and comparator names.
BLOCKING_RULES = (
    "AuthoritativeIdentifier",
    "FamilyNameAndBirthDate",
    "PhoneticFamilyNameAndBirthDate",
    "PostcodeAndBirthDate",
    "Phone",
    "Email",
)
COMPARATORS = (
    "Exact",
    "JaroWinkler",
    "NormalisedDamerauLevenshtein",
    "DiceCoefficient",
    "Phonetic",
    "Nickname",
)

REGISTRY_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}\Z")
MAX_LEXICON_ENTRIES = 10_000


class ConfigurationError(ValueError):
    """A rule set that must not be used."""


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigurationError(message)


@dataclass(frozen=True)
class Weights:
    family: float = 0.25
    given: float = 0.20
    birth_date: float = 0.30
    address: float = 0.15
    telecom: float = 0.07
    gender: float = 0.03

    def in_order(self) -> tuple[float, ...]:
        return (self.family, self.given, self.birth_date, self.address, self.telecom, self.gender)

    @property
    def total(self) -> float:
        total = 0.0
        for weight in self.in_order():
            total += weight
        return total

    def check(self) -> None:
        for weight in self.in_order():
            _require(math.isfinite(weight) and 0 <= weight <= 1, "weights must lie in [0, 1]")
        _require(self.total > 0, "at least one weight must be positive")


@dataclass(frozen=True)
class Lexicon:
    """One reviewed nickname list: normalised name -> group key."""

    version: str
    culture: str
    groups: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, version: str, culture: str, groups: dict[str, str]) -> "Lexicon":
        return cls(version, culture, tuple(sorted(groups.items())))


@dataclass(frozen=True)
class Comparators:
    version: str = "comparators-v1"
    family: tuple[str, ...] = ("JaroWinkler", "Phonetic")
    given: tuple[str, ...] = ("JaroWinkler",)
    phonetic_floor: float = 0.85
    nickname_floor: float = 0.92
    lexicons: tuple[Lexicon, ...] = ()

    def check(self) -> None:
        for floor in (self.phonetic_floor, self.nickname_floor):
            _require(math.isfinite(floor) and 0 < floor <= 1, "floors must lie in (0, 1]")
        for kinds in (self.family, self.given):
            _require(len(kinds) > 0, "each name field needs a comparator")
            _require(len(set(kinds)) == len(kinds), "a comparator may be listed once per field")
            _require(set(kinds) <= set(COMPARATORS), f"unknown comparator in {kinds}")
        if "Nickname" in self.family + self.given:
            _require(len(self.lexicons) > 0, "Nickname needs at least one lexicon")
        entries = sum(len(lexicon.groups) for lexicon in self.lexicons)
        _require(entries <= MAX_LEXICON_ENTRIES, "nickname lexicons hold too many entries")

    @classmethod
    def from_dict(cls, d: dict) -> "Comparators":
        base = cls()
        lexicons = tuple(
            Lexicon.of(item["version"], item["culture"], dict(item["groups"]))
            for item in d.get("lexicons", ())
        )
        made = cls(
            d.get("version", base.version),
            tuple(d.get("family", base.family)),
            tuple(d.get("given", base.given)),
            float(d.get("phonetic_floor", base.phonetic_floor)),
            float(d.get("nickname_floor", base.nickname_floor)),
            lexicons,
        )
        made.check()
        return made


@dataclass(frozen=True)
class ProbabilityModel:
    """m and u per field and comparison level, with the prior match probability."""

    version: str
    prior: float
    levels: tuple[tuple[str, str, float, float], ...]  # field, level, m, u
    dataset_digest: str | None = None

    def check(self) -> None:
        _require(math.isfinite(self.prior) and 0 < self.prior < 1, "the prior must lie in (0, 1)")
        seen = {(name, level) for name, level, _, _ in self.levels}
        wanted = {(name, level) for name in EVIDENCE_FIELDS for level in COMPARISON_LEVELS}
        _require(
            seen == wanted and len(self.levels) == len(wanted),
            "the model needs every field at every level exactly once",
        )
        for name in EVIDENCE_FIELDS:
            for column in (2, 3):
                values = [row[column] for row in self.levels if row[0] == name]
                _require(all(0 < value < 1 for value in values), "m and u must lie in (0, 1)")
                _require(abs(sum(values) - 1) <= 1e-6, f"{name}: m and u must each sum to 1")

    @classmethod
    def from_dict(cls, d: dict) -> "ProbabilityModel":
        made = cls(
            d["version"],
            float(d["prior"]),
            tuple((r["field"], r["level"], float(r["m"]), float(r["u"])) for r in d["levels"]),
            d.get("dataset_digest"),
        )
        made.check()
        return made


def check_fs_model(df) -> ProbabilityModel:
    """Read a (version, prior, field, level, m, u) table of 24 rows into a checked model."""
    rows = df.select("version", "prior", "field", "level", "m", "u").limit(25).collect()
    _require(len(rows) == 24, "the model table must hold 24 rows")
    made = ProbabilityModel(
        rows[0]["version"], rows[0]["prior"],
        tuple((r["field"], r["level"], r["m"], r["u"]) for r in rows),
    )
    made.check()
    return made


def _count(value) -> int | None:
    return None if value is None else int(value)


@dataclass(frozen=True)
class MatchingProfile:
    version: str = "kinweave-people-v1"
    weights: Weights = Weights()
    possible: float = 0.62
    probable: float = 0.82
    max_candidates: int | None = None  # None: every candidate; a number: larger sets are refused, as rows
    default_results: int = 10
    max_results: int | None = None  # None: as many as are asked for; asking for more is an error
    blocking_rules: tuple[str, ...] = BLOCKING_RULES
    identifier_systems: tuple[str, ...] = (NHS_SYSTEM,)
    comparators: Comparators = Comparators()
    model: ProbabilityModel | None = None

    @classmethod
    def default(cls) -> "MatchingProfile":
        return cls()

    def check(self) -> "MatchingProfile":
        _require(
            math.isfinite(self.possible) and math.isfinite(self.probable)
            and 0 <= self.possible < self.probable <= 1,
            "thresholds must satisfy 0 <= possible < probable <= 1",
        )
        self.weights.check()
        _require(len(self.blocking_rules) > 0, "at least one blocking rule is needed")
        _require(
            len(set(self.blocking_rules)) == len(self.blocking_rules)
            and set(self.blocking_rules) <= set(BLOCKING_RULES),
            "blocking rules must be known and listed once",
        )
        _require(
            len(set(self.identifier_systems)) == len(self.identifier_systems),
            "identifier systems must be unique",
        )
        for system in self.identifier_systems:
            _require(
                re.match(r"[A-Za-z][A-Za-z0-9+.-]*:\S+\Z", system) is not None,
                f"identifier system {system!r} is not an absolute URI",
            )
        _require(self.max_candidates is None or self.max_candidates >= 1, "the candidate cap must be positive")
        _require(
            1 <= self.default_results
            and (self.max_results is None or self.default_results <= self.max_results)
            and (None in (self.max_results, self.max_candidates) or self.max_results <= self.max_candidates),
            "result counts must satisfy 1 <= default <= maximum <= cap",
        )
        self.comparators.check()
        if self.model is not None:
            self.model.check()
        return self

    @classmethod
    def from_dict(cls, d: dict) -> "MatchingProfile":
        base = cls()
        made = cls(
            version=d.get("version", base.version),
            weights=Weights(**d["weights"]) if "weights" in d else base.weights,
            possible=float(d.get("possible", base.possible)),
            probable=float(d.get("probable", base.probable)),
            max_candidates=_count(d.get("max_candidates", base.max_candidates)),
            default_results=int(d.get("default_results", base.default_results)),
            max_results=_count(d.get("max_results", base.max_results)),
            blocking_rules=tuple(d.get("blocking_rules", base.blocking_rules)),
            identifier_systems=tuple(d.get("identifier_systems", base.identifier_systems)),
            comparators=Comparators.from_dict(d.get("comparators", {})),
            model=ProbabilityModel.from_dict(d["model"]) if d.get("model") else None,
        )
        return made.check()


@dataclass(frozen=True)
class Secret:
    version: str
    secret: bytes = field(repr=False)
    is_active: bool = True


@dataclass(frozen=True)
class SourcePolicy:
    trust: int = 0
    is_authoritative: bool = False


@dataclass(frozen=True)
class TenantConfig:
    tenant_id: str
    secrets: tuple[Secret, ...]
    profile: MatchingProfile = MatchingProfile()
    sources: tuple[tuple[str, SourcePolicy], ...] = ()
    required_approvals: int = 2

    @property
    def active_secret(self) -> Secret:
        return next(item for item in self.secrets if item.is_active)

    @property
    def authoritative_sources(self) -> tuple[str, ...]:
        return tuple(name for name, policy in self.sources if policy.is_authoritative)

    def check(self) -> "TenantConfig":
        _require(REGISTRY_ID.match(self.tenant_id) is not None, "malformed tenant id")
        self.profile.check()
        check_secrets(self)
        names = [name for name, _ in self.sources]
        _require(len(set(names)) == len(names), "source systems must be unique")
        for name, policy in self.sources:
            _require(REGISTRY_ID.match(name) is not None, f"malformed source system {name!r}")
            _require(0 <= policy.trust <= 100, "trust must lie in 0..100")
        _require(self.required_approvals in (1, 2), "required approvals must be one or two")
        return self


def check_secrets(cfg: TenantConfig) -> None:
    """Exactly one active secret, unique versions, 256 bits or more each."""
    _require(sum(item.is_active for item in cfg.secrets) == 1, "exactly one secret must be active")
    _require(
        len({item.version for item in cfg.secrets}) == len(cfg.secrets),
        "secret versions must be unique",
    )
    _require(all(len(item.secret) >= 32 for item in cfg.secrets), "secrets need 256 bits or more")


def effective_config(base: TenantConfig, settings: dict | None) -> TenantConfig:
    """Overlay the newest tenant settings row on the base configuration."""
    if settings is None:
        return base
    profile = replace(
        base.profile,
        version=settings["profile_version"],
        possible=settings["possible"],
        probable=settings["probable"],
    )
    sources = tuple(
        (item["source"], SourcePolicy(item["trust"], item["is_authoritative"]))
        for item in settings["sources"]
    )
    return replace(
        base,
        profile=profile,
        sources=sources,
        required_approvals=settings["required_approvals"],
    ).check()


def run_label(cfg: TenantConfig) -> str:
    """SHA-256 over every setting that can change a result; secrets enter only as a keyed proof."""
    body = asdict(cfg)
    body["secrets"] = sorted(
        (
            item.version,
            item.is_active,
            hashlib.sha256(b"kinweave-run-label\0" + item.secret).hexdigest(),
        )
        for item in cfg.secrets
    )
    body["sources"] = sorted(body["sources"])
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()
