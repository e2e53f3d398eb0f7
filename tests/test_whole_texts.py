"""Registered queries read whole texts, not their beginnings."""

import html

from sheafspark.plans import catalog


def test_otsl_html(spark, tmp_path):
    """Against a plain version: every word of a text has its cell."""
    texts = ["", "a", "a b", "a b c", "a b c d <e> & f g h", " ".join(f"w{i}" for i in range(301)), None]
    rows = [(i, i % 2, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def plain(text):
        words = [html.escape(w) for w in (text or "").split(" ")]
        out = ""
        for at in range(0, len(words), 3):
            own = words[at : at + 3]
            pad = "<td></td>" if len(own) == 1 and len(words) > 1 else ""
            out += "<tr>" + "".join(f"<td>{w}</td>" for w in own[:2]) + pad + "</tr>"
            out += f'<tr><td colspan="2">{own[2]}</td></tr>' if len(own) == 3 else ""
        return "" if text is None else f"<table>{out}</table>"

    got = {(r.conv_id, r.turn): r.html for r in catalog.queries()["otsl_html"](spark, str(tmp_path)).collect()}
    assert got == {(i, k): plain(t) for i, k, t in rows}
