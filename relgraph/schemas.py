"""Schemas of the input files."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from relgraph.operators.profiles import CAREER

# Alternative key names of one roster field, in order of preference.
ROSTER_FIELDS = {
    "name": ["name"],
    "party": ["party"],
    "region": ["선거구", "region"],
    "committee": ["소속위원회", "committees", "committee"],
    "election_text": ["당선횟수", "election_count"],
    "phone": ["사무실 전화", "phone"],
    "email": ["이메일", "email"],
    "office": ["사무실 호실"],
    "homepage": ["개별 홈페이지"],
    "photo_url": ["photo_url"],
    "photo_filename": ["photo_filename"],
    "detail_link": ["detail_link", "detail_url"],
    "mona_code": ["monaCd"],
    "unit": ["unit", "daesu"],
    "gender": ["gender"],
    "election_method": ["election_method"],
    "row_number": ["rownum", "number"],
    "detailed_party": ["detailed_party"],
}
CAREER_FIELDS = [CAREER, "career"]

ROSTER = StructType(
    [StructField(k, StringType()) for keys in ROSTER_FIELDS.values() for k in keys]
    + [StructField(k, ArrayType(StringType())) for k in CAREER_FIELDS]
)

PERSON_CSV = StructType(
    [StructField(k, StringType()) for k in ("name", "wiki_url", "출생지", "소속", "배우자", "가족")]
)
