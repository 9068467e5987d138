"""Repetitive texts with very many pairs of equal windows give what short ones give."""

from gridloom.llm.decontaminate import Codes, Index


def test_an_edited_copy_after_a_long_repetition_counts_whole():
    tail = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    copy = " ".join(["tick tock"] * 40 + tail[:20] + ["changed"] + tail[20:])
    index = Index([("i", " ".join(["tick tock"] * 40 + tail))])
    found = [index.find("tick tock " * lead + "pause now please " + copy, Codes(), 0.6) for lead in (10, 3000)]
    assert [m[0][:3] for m in found] == [found[0][0][:3]] * 2 and found[0][0][1] > 0.9
