import pytest

from anamnesis.api import Store


@pytest.fixture(scope="module")
def store(spark, sf):
    return Store(spark, sf)


def test_search_keeps_to_project_agent_and_budget(store):
    project = store.table("memories").where("project is not null").groupBy("project").count().orderBy("count", ascending=False).first()[0]
    got = store.call("search", query="the cache", limit=50, project=project).collect()
    assert got and all(r["project"] in (project, None) for r in got)
    few = store.search("the cache", 50, project, budget=200).count()
    assert 0 < few < len(got)
    assert store.search("the cache", agent="nobody").count() == 0
    assert store.search("").count() == 0
    assert store.search("the cache", agent="*").count() == 20


@pytest.mark.parametrize(
    "name,payload",
    [
        ("smart-search", {"query": "database cache"}), ("timeline", {"anchor": "2026-03-01 00:00:00"}), ("profile", {"project": "proj-amber-lease"}), ("patterns", {"least": 1}), ("facet-stats", {}),
        ("facet-query", {"wanted": [("memory_type", "bug")]}), ("retention-score", {"as_of": "2026-07-01 00:00:00"}), ("privacy", {}), ("graph-query", {}), ("replay-sessions", {}), ("verify", {}),
    ],
)
def test_functions_answer(store, name, payload):
    assert store.call(name, **payload).count() > 0


def test_images_and_graph_neighbours(store):
    row = store.table("image_vectors").where("size(vector) = 64").first()
    best = store.vision_search(list(row["vector"]), top_k=3).collect()
    assert len(best) == 3 and best[0]["score"] == pytest.approx(1.0)
    node = store.graph_query(size=1).first()["node"]
    assert {r["depth"] for r in store.graph_query(start=node, depth=1).collect()} == {0, 1}


def test_unknown_function(store):
    with pytest.raises(KeyError):
        store.call("nothing")
