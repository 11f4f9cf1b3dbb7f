"""All queries of the core library and the SQL that checks them."""

from __future__ import annotations

from emberline.plans import forms, relational, security, streams, training, workflows


def queries() -> dict:
    return {**training.QUERIES, **relational.Q, **security.Q, **streams.Q, **workflows.Q, **forms.Q}


def oracle_sql() -> dict[str, str]:
    return {**training.ORACLE, **relational.S, **security.S, **streams.S, **workflows.S, **forms.S}
