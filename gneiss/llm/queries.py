"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import alignment, chat, decontam, html, langid, lm, mixing, neardup, overlap, quality, secrets, spelling, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontam": decontam.op2_decontam,
    "op3_html": html.op3_html,
    "op4_warc": warc.op4_warc,
    "op5_langid": langid.op5_langid,
    "op6_lm": lm.op6_lm,
    "op7_mixing": mixing.op7_mixing,
    "op8_chat": chat.op8_chat,
    "op9_neardup": neardup.op9_neardup,
    "op10_secrets": secrets.op10_secrets,
    "op11_overlap": overlap.op11_overlap,
    "op12_alignment": alignment.op12_alignment,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE = {
    "op4_warc": warc.OP4_SQL,
    "op1_quality": quality.OP1_SQL,
    "op2_decontam": decontam.OP2_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_chat": chat.OP8_SQL,
    "op9_neardup": neardup.OP9_SQL,
    "op11_overlap": overlap.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
