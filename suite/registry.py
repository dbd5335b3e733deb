"""All check queries and their SQL."""

from suite import jobs, keys, pixels, scoring, sources, tokens, validate

SECTIONS = [sources, validate, pixels, tokens, keys, scoring, jobs]


def queries():
    return {name: query for section in SECTIONS for name, query in section.QUERIES.items()}


def oracles():
    return {name: sql for section in SECTIONS for name, sql in section.ORACLES.items()}
