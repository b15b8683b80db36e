"""Tables with a row for each artifact, or with texts of sections, aren't broadcast: the driver would hold all of them."""

import re

import pytest

from docstrata.operators import direction, graph, report
from docstrata.plans import queries as plans

DATA = "/root/testdata/sf0.001"


def broadcast_keys(df):
    """The first key of each join that Spark plans to broadcast, by the sizes of files."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return set(re.findall(r"BroadcastHashJoin \[(?:cast\()?(\w+)#", plan))


@pytest.fixture(scope="module")
def corpus(spark):
    plans.forget()
    yield plans.derived(spark, DATA)
    plans.forget()


def made(c):
    chosen, edges = c.chosen(), c.edges()
    vectors, members = plans.written(c.relation("vectors")), c.members()
    return {
        "edges": graph.orient(c.refs().drop("edge_type"), chosen),
        "chain": graph.entity_chain(c.mentions(), chosen),
        "profile": direction.cluster_profile(vectors, chosen),
        "labels": direction.direction_labels(vectors, chosen, edges, c.confirmed()),
        "inputs": direction.direction_inputs(c.labels(), chosen),
        "snapshot": direction.direction_snapshot(members, chosen, c.names()),
        "timeline": report.timeline(c.dates(), c.relation("artifacts")),
        "activity": report.recent_activity(c.events(), c.names()),
        "stale": report.stale_section(c.labels(), c.names()),
    }


def test_rows_of_artifacts_are_merged(corpus):
    keys = {name: broadcast_keys(df) for name, df in made(corpus).items()}
    assert {name: found & {"artifact_id", "src", "dst", "kind"} for name, found in keys.items()} == dict.fromkeys(keys, set())


def test_texts_of_sections_are_merged(corpus):
    assert not broadcast_keys(plans.QUERIES["report_markdown"](corpus.spark, DATA))


def test_each_section_is_written_by_itself(corpus):
    assert len({f.rsplit("/", 1)[0] for f in plans._sections(corpus).inputFiles()}) == 5
