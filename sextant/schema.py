"""Table layouts as DDL."""

CHUNKS = (
    "id string, repo string, branch string, path string, domain string, type string, fqn string, title string, section string, "
    "symbols array<string>, git_sha string, content_hash string, lang string, text string, vector array<float>, seq bigint"
)
GRAPH_EVENTS = "seq bigint, kind string, id string, label string, tags array<string>, signature string, javadoc string, src string, dst string, edge_type string, tag string"
NODES = "id string, label string, tags array<string>, signature string, javadoc string"
EDGES = "src string, dst string, type string, seq bigint"
CHECKPOINTS = "repo string, branch string, sha string"
FILES = "repo string, branch string, path string, git_sha string, content string, seq bigint"
CHANGES = "kind string, path string"
# The kinds of edges.
EDGE_TYPES = ("DECLARES", "CALLS", "DEPENDS_ON", "EXPOSES", "CONSUMES", "PRODUCES", "IMPLEMENTS", "EXTENDS", "DESCRIBES", "MENTIONS", "SPECIFIES")
