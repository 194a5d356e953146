"""Re-extraction over the stored state, as a version of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticemill.operators import evidence, reextraction
from noticemill.operators.reextraction import Reextraction
from noticemill.session import broadcast_if_small, cut_lineage
from noticemill.sources.store import VersionedStore


def _store(state: VersionedStore, version: int, done: Reextraction) -> Reextraction:
    fields = state.stage_changes(version, "fields", done.fields)
    notices = state.stage_changes(version, "notices", done.notices)
    state.commit(version)
    return Reextraction(notices, fields, done.refused)


def reextract_stored(state: VersionedStore, version: int, ids: DataFrame, pages: DataFrame | None = None) -> Reextraction | None:
    """Extract the named notices of the state again; reads only their rows. A committed version is not run again."""
    if state.is_committed(version):
        return None
    named = ids.select("notice_id").distinct()
    return _store(state, version, reextraction.reextract(
        state.read("notices", among=named), named, state.read("corrections"), pages))


def backfill_stored(state: VersionedStore, version: int, pages: DataFrame | None = None) -> Reextraction | None:
    """Bring all outdated notices of the state to the current version of the extraction."""
    if state.is_committed(version):
        return None
    return _store(state, version, reextraction.backfill(
        state.read("notices"), state.read("fields", ["notice_id"]), state.read("corrections"), pages))


def correct_stored(state: VersionedStore, version: int, requests: DataFrame) -> DataFrame | None:
    """Store the allowed corrections and replay all corrections of the notices they name; returns the rejected ones.

    ``requests``: notice_id, field_name, corrected_value, reason, corrected_at, correction_id.
    """
    if state.is_committed(version):
        return None
    wanted = requests.where(F.col("notice_id").isNotNull())
    values = state.read("fields", among=wanted.select("notice_id", "field_name"))
    accepted, rejected = evidence.check_corrections(wanted, values)
    added = state.stage_changes(version, "corrections", accepted)
    # all corrections of these notices, as their numbers run over all fields
    mine = cut_lineage(state.read("corrections").unionByName(added).join(
        broadcast_if_small(added.select("notice_id").distinct()), "notice_id", "left_semi"))
    replayed = evidence.replay_corrections(state.read("fields", among=mine), mine)
    state.stage_changes(version, "fields", replayed)
    state.commit(version)
    return rejected
