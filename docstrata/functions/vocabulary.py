"""Word lists and templates. All are fixed values: results depend on them."""

TOOLS = [
    "python", "r studio", "rstudio", "matlab", "excel", "spss", "origin", "labview", "git", "github", "docker", "aws", "tensorflow", "pytorch",
    "graphpad", "prism", "imagej", "jupyter", "sql", "jmp", "minitab", "sas", "comsol", "autocad", "solidworks", "matplotlib", "numpy", "pandas",
]

#: Entity families in the order of their rules: kind, Java pattern, confidence.
ENTITY_RULES = [
    ("tool", r"(?i)\b(?:" + "|".join(TOOLS) + r")\b", 0.60),
    ("experiment", r"(?i)\b(?:Experiment|Trial|Run)\s+#?[A-Za-z0-9][\w-]*", 0.70),
    ("hypothesis", r"(?i)\bHypothesis\s+#?[A-Za-z0-9][\w-]*", 0.70),
    ("cost", r"\$\s?\d[\d,]*(?:\.\d+)?(?:\s?[kKmM]\b)?|\b\d[\d,]*(?:\.\d+)?\s?(?:USD|dollars)\b", 0.70),
    ("citation", r"\([A-Z][A-Za-z-]+(?:\s+et al\.)?,?\s+\d{4}\)|\b10\.\d{4,9}/[^\s,;)]+|\[\d+\]", 0.70),
]

#: How the matches of these rules start, by pattern: at most places none of a rule's alternatives is tried.
ENTITY_STARTS = {
    rule[1]: start
    for rule, start in zip(ENTITY_RULES, [r"\b(?=(?i:p[yrat]|r[ s]|m[ai]|ex|sp|or|la|gi|do|aw|te|gr|im|ju|sq|jm|sa|co|au|so|nu))", r"\b(?=(?i:experiment|trial|run))", r"\b(?=[hH])", r"(?=[$0-9])", r"(?=[(\[1])"])
}

#: Labels of a named-entity model: kind, confidence.
MODEL_LABELS = {"PERSON": ("person", 0.75), "ORG": ("group", 0.65)}

PROMISES = [
    r"\bstill need(?:s|ed)?\b", r"\bwe need to\b", r"\bTBD\b", r"\bto be determined\b", r"\bto be confirmed\b", r"\bwaiting on\b", r"\bwaiting for\b",
    r"\bpending\b", r"\bnext steps?\s*:", r"\byet to be\b", r"\bhave yet to\b", r"\bremains?\s+to\s+be\b", r"\bto[- ]?do\s*:", r"\bfuture work\b",
]

#: Of these, a text that matches the marker at the same place of PROMISES holds one, in lower case.
PROMISE_STEMS = [
    ["still need"], ["we need to"], ["tbd"], ["to be determined"], ["to be confirmed"], ["waiting on"], ["waiting for"],
    ["pending"], ["next step"], ["yet to be"], ["have yet to"], ["remain"], ["todo", "to do", "to-do"], ["future work"],
]

STOPWORDS = [
    "this", "that", "these", "those", "with", "from", "have", "will", "been", "were", "what", "when", "where", "which", "while", "about", "into", "over",
    "under", "there", "their", "they", "would", "could", "should", "after", "before", "still", "need", "needs", "needed", "wait", "waiting", "pending",
    "determine", "determined", "confirm", "confirmed", "yet", "next", "step", "steps", "remain", "remains", "future", "work",
]

#: domain, ordinal, phase
PHASES = [
    ("research", 0, "Conceptualization & Planning"),
    ("research", 1, "Execution"),
    ("research", 2, "Analysis"),
    ("research", 3, "Reporting & Dissemination"),
    ("engineering", 0, "Initiation"),
    ("engineering", 1, "Planning & Design"),
    ("engineering", 2, "Execution"),
    ("engineering", 3, "Monitoring & Control"),
    ("engineering", 4, "Closure"),
    ("generic", 0, "Start"),
    ("generic", 1, "Middle"),
    ("generic", 2, "Recent"),
]

SECTIONS = [("overview", "Overview"), ("current_direction", "Current Direction"), ("recent_activity", "Recent Activity"), ("open_gaps", "Open Gaps"), ("stale_artifacts", "Flagged Stale Artifacts")]
