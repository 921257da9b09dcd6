"""Operators for preparing training data: quality, line and n-gram
deduplication, language, sharding, secrets, token counts, decontamination,
mixing and fingerprints.

Every operator takes a DataFrame with the columns ``doc_id`` and ``text`` (and
what it names besides), ignores every other column, and leaves the caller's
session settings alone.  Rules that hold for all of them:

* null text counts as empty unless the operator says otherwise;
* a row is known by (doc_id, hash of its text): repeated rows get equal
  results, one result row for each input row;
* an empty table gives an empty result with the same columns.
"""
