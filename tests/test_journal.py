from __future__ import annotations

import os
import shutil

import pytest

from siftworks.sources import journal as J

PLAN = "source string, destination string, effect string, ts_micros long, seq long"


@pytest.fixture
def box(frame, tmp_path):
    """A folder with files, and plans by name."""
    (tmp_path / "in").mkdir()
    for name in ("move", "delete", "copy", "other"):
        (tmp_path / "in" / name).write_text(name)
    (tmp_path / "in" / "tree").mkdir()
    (tmp_path / "in" / "tree" / "x").write_text("x")

    class Box:
        root, out = tmp_path / "in", tmp_path / "out"
        journal = str(tmp_path / "journal")

        def plan(self, **steps):
            rows = [
                (str(self.root / name), str(self.out / name) if effect != "delete" else None, effect, i, i)
                for i, (name, effect) in enumerate(steps.items())
            ]
            return frame(rows, PLAN)

        def done(self, report):
            return {r.source.rsplit("/", 1)[1]: (r.done, r.error) for r in report.collect()}

    return Box()


def test_actions(box):
    plan = box.plan(move="move", delete="delete", copy="copy", tree="move", missing="move", missing2="delete")
    assert box.done(J.carry_out(plan, box.journal)) == {
        "move": (True, None), "delete": (True, None), "copy": (True, None), "tree": (True, None),
        "missing": (False, None), "missing2": (False, None),
    }
    assert {p.name for p in box.root.iterdir()} == {"copy", "other"}
    assert {p.name for p in box.out.iterdir()} == {"move", "copy", "tree"} and (box.out / "tree" / "x").read_text() == "x"


def test_a_finished_batch_does_nothing(box):
    plan = box.plan(move="move", delete="delete")
    J.carry_out(plan, box.journal)
    (box.root / "move").write_text("new")
    (box.root / "delete").write_text("new")
    assert box.done(J.carry_out(plan, box.journal)) == {"move": (True, None), "delete": (True, None)}
    assert (box.root / "move").read_text() == "new" and (box.out / "move").read_text() == "move"


@pytest.mark.parametrize("dead", ["before", "held", "delivered", "replaced", "report"])
def test_a_batch_that_died_is_finished(box, dead):
    """The attempt died before it did anything, with the file taken, delivered, replaced by another one since, or while it reported."""
    plan = box.plan(move="move", delete="delete")
    intents = {r.effect: r for r in J.prepare(plan, box.journal).collect()}
    move, delete = intents["move"], intents["delete"]
    held = J.held_name(move.destination, move.source, move.token), J.held_name(None, delete.source, delete.token)
    box.out.mkdir()
    if dead == "held":
        os.rename(move.source, held[0])
        os.rename(delete.source, held[1])
    elif dead != "before":
        os.rename(move.source, move.destination)
        os.remove(delete.source)
    if dead == "replaced":
        (box.root / "move").write_text("somebody else's")
        (box.root / "delete").write_text("somebody else's")
    if dead == "report":
        J.carry_out(plan, box.journal)
        os.remove(f"{box.journal}/report/_SUCCESS")
    found = box.done(J.carry_out(box.plan(other="delete"), box.journal))
    assert found["move"] == (True, None)
    assert found["delete"] == ((False, J.CHANGED) if dead == "replaced" else (True, None))
    assert (box.out / "move").read_text() == "move"
    left = {"move", "delete"} if dead == "replaced" else set()
    assert {p.name for p in box.root.iterdir()} == {"copy", "other", "tree"} | left
    assert [p.name for p in box.out.iterdir()] == ["move"]


def test_what_changed_in_between_is_left_alone(box):
    plan = box.plan(move="move", delete="delete", tree="move")
    J.prepare(plan, box.journal)
    (box.root / "move").write_text("longer by now")
    (box.root / "delete").write_text("longer by now")
    shutil.rmtree(box.root / "tree")
    found = box.done(J.carry_out(plan, box.journal))
    assert found == {"move": (False, J.CHANGED), "delete": (False, J.CHANGED), "tree": (False, J.GONE)}
    assert (box.root / "move").exists() and (box.root / "delete").exists()


def test_a_failure_is_a_row(box):
    (box.out.parent / "out").write_text("a file where a folder should be")
    found = box.done(J.carry_out(box.plan(move="move", delete="delete"), box.journal))
    assert not found["move"][0] and found["move"][1] and found["delete"] == (True, None)
