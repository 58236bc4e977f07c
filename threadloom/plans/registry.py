"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from threadloom.plans import q_calendar, q_handed, q_landing, q_meetings, q_more, q_people, q_privacy, q_scalar, q_sources, q_views

QUERIES = q_scalar.QUERIES | q_people.QUERIES | q_views.QUERIES | q_sources.QUERIES | q_more.QUERIES | q_landing.QUERIES | q_handed.QUERIES | q_meetings.QUERIES | q_calendar.QUERIES | q_privacy.QUERIES
SQL = q_scalar.SQL | q_people.SQL | q_views.SQL | q_sources.SQL | q_more.SQL | q_landing.SQL | q_handed.SQL | q_meetings.SQL | q_calendar.SQL | q_privacy.SQL
