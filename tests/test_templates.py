"""Compiled templates against what they should say, and what is refused."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import templates

KIND = "id long, name string, size int, score double, tags array<string>, parts array<struct<kind: string, n: int>>, info struct<city: string, zip: string>, extra map<string, string>, ok boolean, `odd name` string"
ROWS = [
    (1, "Red Cat", 12, 0.5, ["b", "a", "b"], [("x", 1), ("y", None)], ("Ulm", None), {"k": "v"}, True, "o"),
    (2, None, None, None, None, None, None, None, None, None), (3, "", 0, 0.0, [], [], (None, "1"), {}, False, ""),
]
CASES = [
    ("{{ name }} ({{ size }})", ["Red Cat (12)", "()", "(0)"]),
    ("{% if name %}yes{% else %}no{% endif %}", ["yes", "no", "no"]),
    ("{% if size > 10 %}large{% elif size == 0 %}none{% else %}unknown{% endif %}", ["large", "unknown", "none"]),
    ("{% for t in tags %}{{ loop.index }}{{ t }}{% if not loop.last %}, {% endif %}{% else %}nothing{% endfor %}", ["1b, 2a, 3b", "nothing", "nothing"]),
    ("{% for p in parts %}{% for t in tags %}{{ p.kind }}{{ t }}{{ loop.length }} {% endfor %}{% endfor %}|", ["xb3 xa3 xb3 yb3 ya3 yb3 |", "|", "|"]),
    ("{{ tags | unique | join('/') | upper }}{{ tags | length }}", ["B/A3", "0", "0"]),
    ("{{ info.city | default('-') }} {{ info['zip'] }} {{ extra.k }} {{ tags[1] }}", ["Ulm v a", "-", "- 1"]),
    ("{{ 'in' if 'a' in tags else 'out' }} {{ 'x' not in name }} {{ name is defined }} {{ size is none }}", ["in True True False", "out True False True", "out True True False"]),
    ("{# note #}{{ (size + 1) * 2 }} {{ ok and name }} {{ name + '!' }}", ["26 True Red Cat!", "False !", "2 False !"]),
    ("a  \n\n  {%- if ok -%}  b  {%- endif -%}  c\n\td", ["abc\nd", "ac\nd", "ac\nd"]),
    ("{{ name | replace('Red', 'Blue') | lower | truncate(6) }}{{ score }}{{ tags | first }}{{ tags | last }}", ["blue c0.5bb", "", "0.0"]),
    ("plain", ["plain"] * 3), ("", [""] * 3),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, KIND)


def test_templates(rows):
    got = rows.select("id", *(templates.compiled(t, rows.schema).alias(f"c{k}") for k, (t, _) in enumerate(CASES))).orderBy("id").collect()
    for k, (template, wanted) in enumerate(CASES):
        assert [r[f"c{k}"] for r in got] == wanted, template


def test_no_python_in_the_plan(rows):
    plan = rows.select(templates.compiled(CASES[4][0], rows.schema))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


@pytest.mark.parametrize("template", ["{{ other }}", "{{ info.street }}", "{{ tags }}", "{% if name %}", "{% for x in name %}{% endfor %}", "{% set a = 1 %}", "{{ name.__class__ }}", "{{ open('f') }}", "{{ 1 + }}", "{{ name | nofilter }}", "{% for t in tags %}{{ u }}{% endfor %}"])
def test_refused(rows, template):
    with pytest.raises(ValueError):
        templates.compiled(template, rows.schema)


def test_fields_of(rows):
    assert templates.fields_of("{{ name }}{% for t in tags %}{{ t }}{{ size }}{% endfor %}{{ name }}", rows.schema) == ["name", "tags", "size"]
    assert rows.select(templates.compiled("{{ name }}", rows.schema.add("odd", "string"))).count() == 3 or F
