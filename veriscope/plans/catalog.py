"""Every registered query of the library and its SQL."""

from veriscope.plans import events, functions, more, outcomes, programs, texts

QUERIES: dict = {**outcomes.QUERIES, **more.QUERIES, **functions.QUERIES, **texts.QUERIES, **programs.QUERIES, **events.QUERIES}
ORACLE: dict = {**outcomes.ORACLE, **more.ORACLE, **functions.ORACLE, **texts.ORACLE, **programs.ORACLE, **events.ORACLE}
