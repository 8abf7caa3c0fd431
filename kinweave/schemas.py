"""Table and nested-record schemas shared by every job, as Spark DDL strings."""

IDENTIFIER = (
    "struct<system:string,value:string,is_verified:boolean,is_authoritative:boolean,use:string>"
)
NAME = "struct<family:string,given:array<string>,use:string,prefix:string,suffix:string>"
ADDRESS = (
    "struct<lines:array<string>,city:string,district:string,postal_code:string,"
    "country:string,use:string>"
)
TELECOM = "struct<system:string,value:string,use:string>"
TAG = "struct<system:string,code:string,display:string>"
PROFILE = (
    f"struct<identifiers:array<{IDENTIFIER}>,names:array<{NAME}>,birth_date:date,gender:string,"
    f"addresses:array<{ADDRESS}>,telecoms:array<{TELECOM}>,is_deceased:boolean,tags:array<{TAG}>>"
)
SOURCE_KEY = "struct<source_system:string,local_id:string>"
BLOCKING_KEY = "struct<version:string,value:string>"
EVIDENCE = (
    "struct<field:string,similarity:double,weight:double,comparator:string,detail:string,"
    "is_missing:boolean,comparison_level:string,log_likelihood_ratio:double>"
)
APPROVAL = "struct<actor:string,decision:string,reason:string,approved_at:timestamp>"

SOURCE_PATIENTS = (
    "tenant_id string, source_system string, local_id string, resource_id string, "
    f"enterprise_id string, profile {PROFILE}, source_trust int, last_updated timestamp, "
    "version bigint"
)
# Which sources an identity owns and which links its person carries are relations of their own, not
# arrays on the identity: an identity with a million sources is a million narrow rows.
CANONICAL_PATIENTS = (
    f"tenant_id string, enterprise_id string, profile {PROFILE}, "
    f"blocking_keys array<{BLOCKING_KEY}>, survivorship_trust int, created_at timestamp, "
    "last_updated timestamp, version bigint, is_active boolean, replaced_by string"
)
CANONICAL_SOURCES = (
    "tenant_id string, enterprise_id string, position bigint, source_system string, local_id string"
)
PERSONS = (
    "tenant_id string, enterprise_id string, created_at timestamp, "
    "last_updated timestamp, version bigint, is_active boolean, replaced_by string"
)
PERSON_LINKS = (
    "tenant_id string, enterprise_id string, position bigint, source_system string, "
    "local_id string, source_resource_id string, assurance string, linked_at timestamp, "
    "reason string"
)
REVIEW_CASES = (
    "tenant_id string, id string, subject_id string, candidate_id string, score double, "
    f"grade string, evidence array<{EVIDENCE}>, profile_version string, status string, "
    "created_at timestamp, updated_at timestamp, version bigint, kind string, "
    f"required_approvals int, approvals array<{APPROVAL}>, sources_to_move array<{SOURCE_KEY}>, "
    "subject_version bigint, candidate_version bigint, policy_locked boolean, "
    "decision_reason string, decided_by string"
)
AUDIT = (
    "tenant_id string, id string, action string, actor string, outcome string, reason string, "
    f"enterprise_id string, source {SOURCE_KEY}, recorded_at timestamp, correlation_id string"
)
RECEIPTS = (
    "tenant_id string, idempotency_key string, payload_digest string, outcome string, "
    "response string, recorded_at timestamp"
)
JOBS = (
    "tenant_id string, id string, kind string, status string, phase string, trigger string, "
    "schedule_key string, source_system string, requested_by string, reason string, "
    "requested_at timestamp, fingerprint string, profile_version string, "
    "window_start timestamp, window_end timestamp, completed_at timestamp, "
    "counters map<string,bigint>"
)
TENANT_SETTINGS = (
    "tenant_id string, profile_version string, possible double, probable double, "
    "required_approvals int, "
    "sources array<struct<source:string,trust:int,is_authoritative:boolean>>, "
    "updated_at timestamp, updated_by string, version bigint"
)

REGISTRY_TABLES = {
    "source_patients": SOURCE_PATIENTS,
    "canonical_patients": CANONICAL_PATIENTS,
    "canonical_sources": CANONICAL_SOURCES,
    "persons": PERSONS,
    "person_links": PERSON_LINKS,
    "review_cases": REVIEW_CASES,
    "audit": AUDIT,
    "receipts": RECEIPTS,
    "jobs": JOBS,
    "tenant_settings": TENANT_SETTINGS,
}

# The closed code lists of the data model.
GENDERS = ("Unknown", "Male", "Female", "Other")
GRADES = ("None", "Possible", "Probable", "Certain")
REVIEW_STATUSES = (
    "Pending", "AwaitingSecondApproval", "Linked", "Split", "Rejected", "Superseded",
)
REVIEW_KINDS = ("PotentialDuplicate", "ManualDuplicate", "Split", "PopulationReconciliation")
EVIDENCE_FIELDS = ("family", "given", "birthDate", "address", "telecom", "gender")
COMPARISON_LEVELS = ("Exact", "Strong", "Partial", "Different")
