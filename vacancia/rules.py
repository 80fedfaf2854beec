"""Vendor hosts, word lists, patterns, thresholds and constants.

Everything here is a published rule that results depend on; the logic that
applies it lives in ``functions`` and ``operators``.
"""
import re
import re

# --- vendors (fixed values) ---
VENDORS = ("greenhouse", "lever", "ashby", "workable")

# Board URL patterns in the order they are tried; group 1 is the company slug.
# The sub-domain form is anchored so that "apply" and "www" are never slugs.
# Patterns apply to lower-cased text; the literal is what each one must contain.
BOARD_URL_PATTERNS = (
    ("greenhouse", "boards.greenhouse.io/", r"boards\.greenhouse\.io/([a-z0-9_-]+)"),
    ("lever", "jobs.lever.co/", r"jobs\.lever\.co/([a-z0-9_-]+)"),
    ("ashby", "jobs.ashbyhq.com/", r"jobs\.ashbyhq\.com/([a-z0-9_-]+)"),
    ("workable", "apply.workable.com/", r"apply\.workable\.com/([a-z0-9_-]+)"),
    ("workable", ".workable.com",
     r"(?:^|[^a-z0-9_-])(?!(?:apply|www)\.)([a-z0-9_-]+)\.workable\.com"),
)
BOARD_HOSTS = ("greenhouse.io", "lever.co", "ashbyhq.com", "workable.com")

GREENHOUSE_API = "https://boards-api.greenhouse.io/v1/boards/"
LEVER_API = "https://api.lever.co/v0/postings/"
ASHBY_API = "https://jobs.ashbyhq.com/api/non-user-graphql"
WORKABLE_API = "https://apply.workable.com/api/v1/widget/accounts/"

ASHBY_OPERATION = "ApiJobBoardWithTeams"
ASHBY_QUERY = (
    "query ApiJobBoardWithTeams($organizationHostedJobsPageName: String!) { "
    "jobBoard: jobBoardWithTeams("
    "organizationHostedJobsPageName: $organizationHostedJobsPageName) { "
    "jobPostings { id title locationName employmentType compensationTierSummary } } }"
)

# Crawl-index URL patterns and their sort-friendly (SURT) prefixes.
CRAWL_PATTERNS = (
    ("boards.greenhouse.io/*", "boards.greenhouse.io", "/"),
    ("boards-api.greenhouse.io/*", "boards-api.greenhouse.io", "/"),
    ("jobs.lever.co/*", "jobs.lever.co", "/"),
    ("jobs.ashbyhq.com/*", "jobs.ashbyhq.com", "/"),
    ("*.workable.com/j/*", ".workable.com", "/j/"),
    ("*.workable.com/jobs/*", ".workable.com", "/jobs/"),
)
SURT_PREFIXES = (
    ("io,greenhouse,boards)", "greenhouse"),
    ("com,ashbyhq,jobs)", "ashby"),
    ("com,workable,apply)", "workable"),
    ("co,lever,jobs)", "lever"),
)

# --- URL extraction character classes (fixed values) ---
URL_PATTERNS = {
    "markdown": r"https?://[^\s)>\]]+",
    "list": r"""https?://[^\s)>\]"']+""",
    "text": r"""https?://[^\s)>\]"'`,]+""",
    "thread": r"""https?://[^\s<)>\]"'`,]+""",
}

# --- title filters (fixed values) ---
IRRELEVANT_TITLE = (
    r"(?i)recruiter|coordinator|sales|marketing|account.?exec|operations.?manager"
    r"|customer.?success|analyst(?!.*data)|designer(?!.*system)|nurse|physician"
    r"|mechanic|electrician|cook|driver|warehouse"
)
RELEVANT_TITLE = (
    r"(?i)engineer|developer|swe\b|sde\b|backend|frontend|fullstack|full.?stack"
    r"|devops|sre|platform|infrastructure|cloud|ai\b|ml\b|machine.?learn"
    r"|data.?scien|software"
)
SOFTWARE_TITLE_LIKE = (
    "%Engineer%", "%Developer%", "%Backend%", "%Frontend%", "%Full Stack%",
    "%ML %", "%Machine Learning%", "%DevOps%", "%SRE%", "%Platform%",
)



def ascii_words(pattern: str) -> str:
    """Spell ``\\b`` as ASCII word edges, whatever the runtime's Unicode rules are.

    Every edge here touches a word character, so a leading one is "no word
    character before" and a trailing one "none after".
    """
    leading = re.sub(r"\\b(?=[(a-z])", lambda _: r"(?<!\w)", pattern)
    return leading.replace(r"\b", r"(?!\w)")


# --- hard constraints (fixed values) ---
# Words that, near "N years", mark it as a requirement.
YEARS_ANCHOR = (
    "(?:experience|professional|work|relevant|engineering|development|software"
    "|industry|background|coding|programming|career|building)"
)
YEARS_TAIL = r"(?:\s+of\s+[^.;\n]{0,80}?" + YEARS_ANCHOR + r"|\s+" + YEARS_ANCHOR + ")"
# For a text in which RANGE_GAP has been closed up, so that a dash of a range touches both numbers.
RANGE_GAP = r"(\d)\s*[-–]\s*(?=\d)"
NOT_AFTER_RANGE = r"(?=\d)(?<!\d-)"
YEARS_RANGE = r"(\d+)\s*[-–]\s*(\d+)\s*(?:years?|yrs?)" + YEARS_TAIL
YEARS_ANCHORED = NOT_AFTER_RANGE + r"(\d+)\+?\s*(?:years?|yrs?)" + YEARS_TAIL
YEARS_MINIMUM = r"(?:minimum|at least|require[sd]?)\s+(\d+)\s*(?:years?|yrs?)"
YEARS_PLUS = NOT_AFTER_RANGE + r"(\d+)\+\s*(?:years?|yrs?)"

CLEARANCE = r"(?:active\s+)?(?:ts/sci|top secret|secret|ts)\s+(?:clearance|security)"

# Without a trailing word boundary these also match prefixes ("la" in
# "language"); ``strict=True`` in the operator adds the boundary.
NON_US_TERMS = (
    "london|paris|berlin|munich|stuttgart|dublin|amsterdam|toronto|vancouver|montreal"
    "|singapore|tokyo|seoul|sydney|melbourne|bangalore|hyderabad|ireland|spain|germany"
    "|france|uk|united kingdom|canada|india|japan|australia|emea|apac|eu\\b"
)
US_TERMS = (
    "united states|usa?\\b|new york|nyc|san francisco|sf|los angeles|la|seattle|austin"
    "|boston|chicago|denver|atlanta|remote.{0,20}(?:us|united states|usa)"
)

PRIMARY_LANGUAGES = (
    ("go", r"\b(?:golang|go\b)"),
    ("rust", r"\brust\b"),
    ("scala", r"\bscala\b"),
    ("c#", r"\bc#|\.net\b|dotnet"),
    ("swift", r"\bswift\b"),
    ("ruby", r"\bruby\b"),
    ("php", r"\bphp\b"),
    ("kotlin", r"\bkotlin\b"),
    ("elixir", r"\belixir\b"),
    ("erlang", r"\berlang\b"),
)
# Any of them, as one pattern: decides whether sentences need to be looked at.
LANGUAGE_MENTION = (
    r"(?<!\w)(?:golang|(?:go|rust|scala|swift|ruby|php|kotlin|elixir|erlang)(?!\w)|c#)"
    r"|\.net(?!\w)|dotnet"
)
PRIMARY_INDICATORS = (
    r"(?:build|maintain|develop|write|using|proficien|expert|strong|require|must|primary|core)\b"
)
SECURITY_OPERATIONS = (
    r"\b(?:vulnerability.?management|security.?operations|soc\b"
    r"|compliance.?(?:engineer|analyst)|security.?tooling|sast.?/?\s?dast|devsecops"
    r"|penetration.?test|red.?team|blue.?team|security.?admin|it.?security"
    r"|information.?security.?(?:officer|analyst)|grc\b)"
)
# Every alternative above contains one of these.
SECURITY_OPERATIONS_WORDS = ("vulnerability", "security", "soc", "compliance", "sast",
                             "devsecops", "penetration", "team", "grc")
SECURITY_TITLE = (
    r"(?i)\b(?:application\s+security|product\s+security|infrastructure\s+security"
    r"|cloud\s+security|cybersecurity)\s+(?:engineer|analyst|specialist|architect)\b"
)

# --- retrieval (fixed values) ---
BM25_K1 = 1.5
BM25_B = 0.75
QUERY_EXPANSION = (
    "software", "engineer", "developer", "backend", "frontend", "fullstack",
    "full-stack", "devops", "sre", "platform", "infrastructure", "cloud",
    "machine", "learning", "data", "security", "new", "grad", "junior",
    "entry", "associate",
)
SENIOR_TITLE = r"\b(senior|sr\.?|staff|principal|lead|director|vp|head of|manager)\b"
JUNIOR_TITLE = r"\b(junior|jr\.?|entry|associate|new grad|intern|early career|i\b|ii\b)\b"
ENGINEER_TITLE = r"\bengineeri?n?g?\b"
SOFTWARE_TITLE = (
    r"\b(software|swe|sde|backend|frontend|fullstack|full.?stack|devops|sre|platform"
    r"|cloud|data|ai|ml|machine.?learn|security)\b"
)
YEARS_REQUIRED = r"(\d+)\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:experience|professional)"
FEATURE_WEIGHTS = (
    ("bm25_norm", 0.20), ("skill_overlap", 0.25), ("level_match", 0.25),
    ("title_relevance", 0.15), ("location_match", 0.10), ("has_description", 0.05),
)

# --- thresholds (fixed values) ---
BAND_PUSH, BAND_DIGEST = 65, 40          # qualifier band and relevance grade
TIER_PUSH, TIER_DIGEST = 70, 40          # everything after the qualifier
GRADE_MARGINAL = 20

# --- feed health and rate control (fixed values) ---
MAX_FAILURES = 5
POLL_INTERVAL_MS = 900_000
RECOVERY_POINTS_S = (600, 3600, 14400)
RECOVERY_REPEAT_S = 86_400
RECOVERY_SWEEP_S = 600
DEFAULT_CEILING = (2, 500)               # concurrent requests, interval in ms
VENDOR_CEILINGS = {
    "greenhouse": (3, 100), "lever": (2, 500), "ashby": (1, 3000), "workable": (1, 1000),
}
AIMD_CLEAN_WINDOW = 10
AIMD_INTERVAL_STEP_MS = 50
AIMD_MAX_BACKOFF = 10
PROBE_INTERVALS = (1000, 500, 250, 100, 50)
PROBE_MAX_CONCURRENT = 20
PROBE_MIN_COMPANIES = 5

# --- messages of failed constraints (fixed values: they are part of the results) ---
FAILED_YEARS_RANGE = "Requires {low}-{high} years experience (max {most})"
FAILED_YEARS = "Requires {low}+ years experience (max {most})"
FAILED_TITLE_TERM = 'Title contains excluded term: "{term}"'
FAILED_CLEARANCE = "Requires security clearance"
FAILED_LOCATION = "Non-US location"
FAILED_LANGUAGE = "Primary language: {language} (not in candidate skills)"
FAILED_SECURITY_OPERATIONS = "Security operations/admin role, not software engineering"
FAILED_SECURITY_TITLE = "Security role title ({title}), not software engineering"
