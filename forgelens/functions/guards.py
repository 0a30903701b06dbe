"""Cheap exact guards in front of the rule regexes.

A guard is a list of lower-case words of which at least one occurs in every
text the regex can match.  A byte search for the words costs a fraction of a
regex pass, and on ordinary source text most rules are settled by it.

Case-insensitive matching folds four non-ASCII characters onto ASCII letters
(I with dot, dotless i, long s, Kelvin sign).  A text holding one of them skips
the guards and goes to the regexes directly, so no match is lost.

The conditions are SQL text: some eighty rules as single Column calls would take
seconds of driver time before a job even starts.
"""

from . import registries as R
from .text import quoted, regex

FOLDING_CHARACTERS = ["\u0130", "\u0131", "\u017f", "\u212a"]

SECRET_GUARDS = {
    "AWS Access Key ID": ["akia"],
    "AWS Secret Access Key": ["aws"],
    "Generic API Key": ["api"],
    "Generic Bearer Token": ["bearer"],
    "Private RSA Key Header": ["private key-----"],
    "GitHub Personal Token": ["ghp_"],
    "Slack Bot Token": ["xoxb-"],
    "Google API Key": ["aiza"],
    "Stripe Secret Key": ["sk_live_"],
    "Generic Password": ["passw", "pwd"],
}

DANGEROUS_GUARDS = {
    "PY-001": ["eval"],
    "PY-002": ["exec"],
    "PY-003": ["subprocess"],
    "PY-004": ["pickle.load"],
    "PY-005": ["yaml.load"],
    "PY-006": ["hashlib.md5"],
    "PY-007": ["hashlib.sha1"],
    "PY-008": ["os.system"],
    "PY-009": ["tempfile.mktemp"],
    "PY-010": ["__import__"],
    "JV-001": ["runtime.getruntime().exec"],
    "JV-002": ["processbuilder"],
    "JV-003": ["execute"],
    "JV-004": ["objectinputstream"],
    "JV-005": ["class.forname"],
    "JV-006": [".setaccessible"],
    "JV-007": ["messagedigest.getinstance"],
    "JV-008": ["messagedigest.getinstance"],
    "JV-009": ['"des'],
    "JV-010": ["csrf"],
    "JV-011": ["random"],
    "JV-012": ["createstatement", "preparestatement"],
}

# one list per pattern, in the order of the registry
SURFACE_GUARDS = {
    "rest_endpoints": [
        ["@app."], ["@router."], ["@api_view"], ["path"], ["url"], ["mapping"],
        ["@get", "@post", "@put", "@delete", "@patch"], ["@path"],
    ],
    "controllers": [
        ["@controller"], ["@restcontroller"], ["controller"], ["view"], ["handler"], ["blueprint"],
    ],
    "auth_modules": [
        ["@login_required"], ["@requires_auth"], ["@authenticated"], ["userdetails"],
        ["authenticationprovider"], ["securityconfig"], ["websecurityconfigurer"],
        ["auth"], ["login"], ["jwt.decode"], ["verify_token"],
    ],
    "file_uploads": [
        ["request.files"], ["file.save"], [".upload"], ["multipartfile"],
        ["multiparthttpservletrequest"], ["@requestpart"], [".transferto"], ["uploadedfile"],
    ],
    "db_access": [
        [".execute"], ["session.query"], ["model.objects."], [".filter"], ["entitymanager"],
        ["jparepository"], ["crudrepository"], ["@repository"], ["datasource"],
        [".query"], ["connection.cursor"],
    ],
    "template_engines": [
        ["render_template"], [".render"], ["velocity"], ["freemarker"], ["thymeleafdialect"],
        [".jsp"], ["jinja2."], ["jinja2"], ["template"],
    ],
    "websockets": [
        ["@serverendpoint"], ["websockethandler"], ["websocket.websocket"],
        ["websockets.connect"], ["flask_socketio"], ["socketio"], ["sockjs"],
    ],
}

LEGACY_ENGINE_GUARDS = {
    "Velocity": ["velocity", ".vm"],
    "FreeMarker": ["freemarker", ".ftl"],
    "JSP": ["jsp"],
    "Apache Struts": ["struts"],
}
DYNAMIC_SQL_GUARD = ["select", ".format"]
PERMIT_ALL_GUARD = ["permitall", ".anonymous"]
REFLECTION_GUARD = [".setaccessible(true)", "class.forname(", "getdeclaredmethod"]

# A look-ahead sees the end of a line differently in a whole text, so the
# whole-text test of this rule leaves it out; the line test keeps it.
WHOLE_TEXT_REGEX = {"PY-005": r"\byaml\.load\s*\([^)]*\)"}


def with_guard_columns(files):
    """Adds what :func:`found` needs: the lower-cased text and its folding flag."""
    folds = " OR ".join(f"contains(content, {quoted(c)})" for c in FOLDING_CHARACTERS)
    return files.selectExpr("*", "lower(content) AS _lowered", f"({folds}) AS _folds")


def possible(words) -> str:
    """SQL condition: one of the words occurs, or the guards do not apply."""
    tests = ["_folds"] + [f"contains(_lowered, {quoted(word)})" for word in words]
    return f"({' OR '.join(tests)})"


def found(pattern: str, flags: str, words) -> str:
    """SQL condition: the text matches the pattern anywhere, guard first."""
    return f"({possible(words)} AND content RLIKE {quoted(regex(pattern, flags))})"


def found_any(patterns, flags: str, word_lists) -> str:
    tests = [found(p, flags, words) for p, words in zip(patterns, word_lists, strict=True)]
    return f"({' OR '.join(tests)})"


def in_category(category: str) -> str:
    patterns = R.ATTACK_SURFACE_PATTERNS[category]
    return found_any(patterns, "im", SURFACE_GUARDS[category])
