import pytest

from sextant.session import ensure_importable, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    ensure_importable(session)
    yield session
    session.stop()


CHUNK = (
    "id string, repo string, branch string, path string, domain string, type string, fqn string, title string, section string, "
    "symbols array<string>, content_hash string, lang string, text string, vector array<float>, seq bigint"
)


@pytest.fixture
def make_chunks(spark):
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def make(*rows):
        base = dict.fromkeys(names) | {"repo": "repo", "path": "p", "domain": "CODE", "type": "CLASS", "symbols": []}
        filled = [base | {"seq": n} | r for n, r in enumerate(rows, 1)]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in filled], CHUNK)

    return make


EVENT = "seq bigint, kind string, id string, label string, tags array<string>, signature string, javadoc string, src string, dst string, edge_type string, tag string"


@pytest.fixture
def make_events(spark):
    names = [c.split()[0] for c in EVENT.split(", ")]

    def node(id, signature=None, javadoc=None, label="Method", tags=()):
        return dict(kind="N", id=id, label=label, tags=list(tags), signature=signature, javadoc=javadoc)

    def edge(src, dst, type="CALLS"):
        return dict(kind="E", src=src, dst=dst, edge_type=type)

    def tag(id, tag):
        return dict(kind="T", id=id, tag=tag)

    def make(*rows):
        return spark.createDataFrame([tuple({"seq": n, **r}.get(c) for c in names) for n, r in enumerate(rows, 1)], EVENT)

    make.node, make.edge, make.tag = node, edge, tag
    return make
