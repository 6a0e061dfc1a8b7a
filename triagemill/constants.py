"""Fixed values of the triage domain."""

# fixed values: severity classes in report order and in rank order
LABELS = ["blocker", "critical", "major", "normal", "minor", "trivial"]
ORDERED_LABELS = ["trivial", "minor", "normal", "major", "critical", "blocker"]
TICKET_LABELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]

# fixed values: label exclusions and groupings
LABEL_EXCLUSIONS = ["enhancement", "task", "feature", "unknown", "n/a", "none", ""]
LABEL_GROUPS = {
    "high": ["blocker", "critical"],
    "medium": ["major", "normal"],
    "low": ["minor", "trivial"],
}
TASKS = {
    "s6": {label: label for label in LABELS},
    "s3": {
        "blocker": "HIGH",
        "critical": "HIGH",
        "major": "MEDIUM",
        "normal": "MEDIUM",
        "minor": "LOW",
        "trivial": "LOW",
    },
    "s2": {
        "blocker": "HIGH_IMPACT",
        "critical": "HIGH_IMPACT",
        "major": "HIGH_IMPACT",
        "normal": "LOWER_IMPACT",
        "minor": "LOWER_IMPACT",
        "trivial": "LOWER_IMPACT",
    },
}
TASK_LABELS = {
    "s6": LABELS,
    "s3": ["HIGH", "MEDIUM", "LOW"],
    "s2": ["HIGH_IMPACT", "LOWER_IMPACT"],
}
HIERARCHIES = {
    "hierarchy_a": {
        "SEVERE": ["blocker", "critical"],
        "NON_SEVERE": ["major", "normal", "minor", "trivial"],
    },
    "hierarchy_b": {
        "HIGH": ["blocker", "critical"],
        "MEDIUM": ["major", "normal"],
        "LOW": ["minor", "trivial"],
    },
}

# fixed values: the core layer
CORE_COLUMNS = [
    "issue_url",
    "issue_id",
    "source_project",
    "source_file",
    "global_report_key",
    "product",
    "component",
    "summary",
    "description",
    "severity",
    "creation_time",
    "dupe_of",
    "has_valid_summary",
    "has_valid_description",
    "has_valid_text",
    "has_valid_severity",
    "is_excluded_label",
    "has_valid_creation_time",
    "exact_text_hash",
    "duplicate_group_id",
]
FORBIDDEN_COLUMNS = [
    "comments",
    "history_activity_log",
    "attachments",
    "creator",
    "creator_detail",
    "assigned_to",
    "assigned_to_detail",
    "cc",
    "cc_detail",
    "qa_contact",
    "priority",
    "status",
    "resolution",
]
CORE_ALIASES = {
    "issue_url": ["issue url", "issue_url", "bug url", "bug_url"],
    "issue_id": ["id", "issue id", "issue_id", "bug id", "bug_id"],
    "product": ["product"],
    "component": ["component"],
    "summary": ["summary", "short desc", "short_desc", "title"],
    "description": ["description", "details", "body", "long_desc"],
    "severity": ["severity", "bug severity", "bug_severity", "sev"],
    "creation_time": ["creation time", "creation_time", "created at", "created_at"],
    "dupe_of": ["dupe of", "dupe_of", "duplicate of", "duplicate_of"],
}
REQUIRED_FIELDS = ["issue_id", "summary", "description", "severity", "creation_time"]
SPLIT_COLUMNS = [
    "id",
    "summary",
    "description",
    "severity",
    "creation_time",
    "product",
    "component",
    "duplicate_group",
]
INELIGIBLE_PREDICTORS = [
    "severity",
    "priority",
    "status",
    "resolution",
    "dupe of",
    "depends on",
    "blocks",
    "assigned to",
    "qa contact",
    "cc",
    "creator",
    "comments",
    "history/activity log",
    "attachments",
    "last change time",
    "deadline",
    "target milestone",
    "flags",
    "whiteboard",
    "is confirmed",
    "is open",
]
LABEL_WORDS = ["blocker", "critical", "major", "normal", "minor", "trivial", "severity"]

# fixed values: decision thresholds
PRIMARY_THRESHOLD = 0.2463
SECONDARY_FLOOR = 0.2163
