"""Explicit schemas of the landed tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, L, D, B, TS = T.StringType(), T.LongType(), T.DateType(), T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(S)

LIST_ITEM = _struct(seq=L, source_name=S, title=S, source_url=S, source_item_id=S, publish_time=D, snippet=S, region=S)
DETAIL = _struct(source_name=S, source_url=S, title=S, publish_time=D, region=S, raw_content=S, clean_content=S,
                 attachment_links=STRINGS, detail_status=S, content_format=S)
PAGE_TEXT = _struct(notice_id=S, page=T.IntegerType(), text=S, method=S)
TASK = _struct(task_id=S, keywords=STRINGS, regions=STRINGS, start_date=D, end_date=D, status=S)
HISTORY = _struct(task_id=S, notice_id=S, content_hash=S, first_delivered_at=S, last_delivered_at=S, report_id=S)
NOTICE = _struct(notice_id=S, title=S, source_name=S, source_url=S, source_item_id=S, publish_time=D, region=S,
                 clean_content=S, summary=S, detail_status=S, content_hash=S, deduplication_key=S, project_code=S,
                 announcement_type=S, is_primary=B, first_seen_at=S, last_seen_at=S, raw_content=S, detail_url=S,
                 extraction_version=S)
NOTICE_SOURCE = _struct(notice_id=S, seq=L, source_name=S, source_url=S, reason=S)
NOTICE_REASON = _struct(notice_id=S, reason=S)
NOTICE_LINK = _struct(notice_id=S, link=S)
LIFECYCLE = _struct(notice_id=S, announcement_id=S, source_name=S, source_url=S, announcement_type=S, relation=S, reason=S)
FIELD = _struct(notice_id=S, field_name=S, value=S, source_label=S, page=T.IntegerType(), quote=S, method=S, status=S,
                evidence_id=S, confidence=S)
#: Items that wait for a place below a cap or for their detail; ``is_gone`` ends the waiting.
PENDING = _struct(item_key=S, why=S, is_gone=B, **{f.name: f.dataType for f in LIST_ITEM.fields})
CORRECTION = _struct(notice_id=S, field_name=S, previous_value=S, corrected_value=S, reason=S, corrected_at=TS,
                     correction_id=L)

LIST_PAYLOAD = T.StructType([T.StructField("object", T.StructType([T.StructField("returnlist", T.ArrayType(_struct(
    businessObjectName=S, businessId=S, regionName=S, receiveTime=S, bulletinEndTime=S, transactionPlatfName=S,
    tenderProjectCode=S, industriesType=S)))]))])
