"""Input tables the operators work on."""

FILES = "repo string, path string, kind string, size_bytes bigint, content string"
REPOS = "repo string, default_branch string, stars int, language string"
COMMITS = "repo string, path string, sha string, author_date timestamp, message string"
DEPENDENCIES = (
    "repo string, dep_file string, pos int, package string, version string, ecosystem string"
)
ADVISORIES = (
    "id string, ecosystem string, package string, "
    "affected array<struct<introduced:string,fixed:string>>, versions array<string>, "
    "summary string, details string, published string, aliases array<string>, raw_json string"
)
AGENT_EVENTS = (
    "session string, seq bigint, author string, tool string, text string, is_final boolean"
)
REPORTS = "repo string, text string"
