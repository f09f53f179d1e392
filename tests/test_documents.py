"""Documents kept up by increments equal full rebuilds, and touch only what changed."""

import os
import random
from datetime import date

import pytest

from loomlog.operators import changelog as ch
from loomlog.operators import edits as ed
from loomlog.operators import library as lb
from loomlog.plans import documents as dc
from loomlog.sources import changes

NOW = "2026-06-20 00:00:00"
VERSIONS = "brain string, path string, run_id long, seq int, action string, content string"
RUNS = "brain string, kind string, section_date date, run_id long, hm string, summary string"


class Crash(Exception):
    pass


def version(brain, category, slug, run, seq, action="create"):
    where = f"library/{category}/{slug}.md" if category else f"library/{slug}.md"
    return (brain, where, run, seq, action, f"---\ntitle: T {slug} {run}\nttl: 30d\nupdated: 2026-06-0{run % 9 + 1}\n---\nbody")


def history(n_runs, seed):
    rng = random.Random(seed)
    out = []
    for run in range(1, n_runs + 1):
        picks = rng.sample([(b, c, s) for b in ("work", "both") for c in ("", "2024", "a b=c/d", "Topic", "topic") for s in "xyz"], 3)
        out += [version(b, c, s, run, i, rng.choice(["create", "update", "delete"])) for i, (b, c, s) in enumerate(picks)]
    return out


class Library:
    def __init__(self, spark, home, rows):
        self.spark, self.home, self.rows = spark, home, rows

    def frames(self, upto):
        versions = self.spark.createDataFrame([r for r in self.rows if r[2] <= upto], VERSIONS)
        catalog = lb.parse_articles(ed.latest_version(versions))
        log = [(b, run, seq, act, path, None) for b, path, run, seq, act, _ in self.rows if run <= upto]
        entries = self.spark.createDataFrame(log, "brain string, run_id long, seq int, action string, path string, note string")
        seen = sorted({(r[0], r[2]) for r in self.rows if r[2] <= upto} | {("idle", 1)})
        runs = self.spark.createDataFrame([(b, "compile", date(2026, 4, 1 + run // 2), run, "10:00", f"s{run}" if run % 2 else None) for b, run in seen], RUNS)
        return catalog, entries, runs

    def refresh(self, upto, since):
        catalog, entries, runs = self.frames(upto)
        edited = self.spark.createDataFrame([(r[0], r[1]) for r in self.rows if since < r[2] <= upto], "brain string, path string")
        return dc.refresh_documents(self.spark, self.home, f"run-{upto}", catalog, edited, entries, runs, runs.filter(f"run_id > {since}"))

    def wanted(self, upto):
        catalog, entries, runs = self.frames(upto)
        return rows_of(lb.library_index(catalog, NOW)), rows_of(ch.changelog(entries, runs))

    def found(self):
        return rows_of(dc.index_document(self.spark, self.home, NOW)), rows_of(dc.changelog_document(self.spark, self.home))

    def files(self, table):
        return {os.path.join(d, f) for d, _, names in os.walk(f"{self.home}/{table}") for f in names if f.startswith("part-")}


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


def test_every_increment_equals_a_rebuild(spark, tmp_path):
    lib = Library(spark, str(tmp_path), history(6, 4))
    assert lib.found() == ([], [])
    before = 0
    for upto in (1, 3, 6):
        assert lib.refresh(upto, before) and not lib.refresh(upto, before)
        assert lib.found() == lib.wanted(upto)
        before = upto


def test_only_dirty_fragments_are_written(spark, tmp_path):
    rows = [version("work", c, "x", 1, i) for i, c in enumerate("abcde")] + [version("work", "a", "y", 8, 0), version("work", "b", "x", 8, 1, "delete")]
    lib = Library(spark, str(tmp_path), rows)
    lib.refresh(1, 0)
    index, log = lib.files("index"), lib.files("changelog")
    lib.refresh(8, 1)
    # One fragment is written anew, one has no articles left, and the new day is one more.
    assert len(index - lib.files("index")) == 2 and len({os.path.dirname(f) for f in lib.files("index")}) == 4
    assert log <= lib.files("changelog")
    assert lib.found() == lib.wanted(8)


def test_files_do_not_grow_with_days(spark, tmp_path):
    """Many days are a few files; a day made anew rewrites only the files that hold it."""
    lib = Library(spark, str(tmp_path), [version("work", "a", "x", run, 0, "update") for run in range(1, 57)])
    lib.refresh(50, 0)
    first = lib.files("changelog")
    assert len(first) <= 4
    # Run 51 falls into the day of run 50.
    lib.refresh(56, 50)
    assert len(first - lib.files("changelog")) == 1 and len(lib.files("changelog")) <= 8
    assert lib.found() == lib.wanted(56)


@pytest.mark.parametrize("n", [0, 1, 4])
def test_refresh_cut_off(spark, tmp_path, monkeypatch, n):
    """The driver is lost at any step: readers who settle see both documents before the run or after it."""
    lib = Library(spark, str(tmp_path), history(3, 8))
    lib.refresh(2, 0)
    left = [n]
    with monkeypatch.context() as m:
        for step in ("_delete", "_move", "_write"):
            def run(*args, own=getattr(changes, step)):
                if left[0] == 0:
                    raise Crash
                left[0] -= 1
                return own(*args)
            m.setattr(changes, step, run)
        try:
            lib.refresh(3, 2)
        except Crash:
            pass
    changes.settle(spark, lib.home)
    assert lib.found() == lib.wanted(2 if n == 0 else 3)
    lib.refresh(3, 2)
    assert lib.found() == lib.wanted(3)
