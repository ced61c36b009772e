"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import boilerplate, covertree, ctw, decontaminate, html, licences, minhash, packing, toxicity, warc

QUERIES = {
    "op1_ctw": ctw.op1_ctw,
    "op2_html": html.op2_html,
    "op3_packing": packing.op3_packing,
    "op4_warc": warc.op4_warc,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_covertree": covertree.op6_covertree,
    "op7_minhash": minhash.op7_minhash,
    "op8_licences": licences.op8_licences,
    "op9_boilerplate": boilerplate.op9_boilerplate,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
#: The rest have none: models, markup and token ids are beyond SQL; tests hold them against brute force.
SQL = {"op4_warc": warc.SQL, "op6_covertree": covertree.SQL, "op7_minhash": minhash.SQL, "op8_licences": licences.SQL, "op9_boilerplate": boilerplate.SQL, "op10_decontaminate": decontaminate.SQL}
