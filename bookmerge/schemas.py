"""Explicit schemas and settings: nothing is inferred from data."""

from __future__ import annotations

from dataclasses import dataclass

ITEM = "struct<value:string,label:string>"
ADDRESS = "struct<street:string,city:string,state:string,postal_code:string,country:string,country_code:string,label:string>"
BIRTHDAY = "struct<year:int,month:int,day:int>"

CONTACT_TYPES = {
    "contact_id": "string", "source": "string",
    "given_name": "string", "middle_name": "string", "family_name": "string", "name_prefix": "string", "name_suffix": "string", "nickname": "string",
    "phonetic_given_name": "string", "phonetic_middle_name": "string", "phonetic_family_name": "string",
    "organization": "string", "department": "string", "job_title": "string",
    "phones": f"array<{ITEM}>", "emails": f"array<{ITEM}>", "addresses": f"array<{ADDRESS}>", "urls": f"array<{ITEM}>",
    "birthday": BIRTHDAY, "note": "string", "photo_data": "binary", "photo_url": "string", "last_modified": "timestamp",
    "google_resource_name": "string", "mac_contact_identifier": "string",
}
CONTACT = ", ".join(f"{k} {v}" for k, v in CONTACT_TYPES.items())
CONTACT_STRUCT = "struct<" + ",".join(f"{k}:{v}" for k, v in CONTACT_TYPES.items()) + ">"

MAPPING = "google_resource_name string, mac_contact_identifier string, last_synced_at timestamp, google_etag string"
EVENT = "id string, timestamp timestamp, source string, action string, details string"
FAILURE = "id string, contact_name string, reason string, failure_count int, last_failed_at timestamp, ignored boolean"
DECISION = "pattern string, decision string, created_at timestamp"
VERSION = f"session_id string, contact_identifier string, version_number int, timestamp timestamp, source string, position int, data {CONTACT_STRUCT}"
SESSION = "id string, timestamp timestamp, type string, google_count int, mac_count int, version_count int"

_SOURCES = "metadata:struct<sources:array<struct<type:string,updateTime:string>>>"
PEOPLE_PAGE = (
    "nextPageToken string, connections array<struct<resourceName:string,etag:string," + _SOURCES + ","
    "names:array<struct<givenName:string,middleName:string,familyName:string,honorificPrefix:string,honorificSuffix:string,phoneticGivenName:string,phoneticMiddleName:string,phoneticFamilyName:string>>,"
    "nicknames:array<struct<value:string>>,organizations:array<struct<name:string,title:string,department:string>>,"
    "phoneNumbers:array<struct<value:string,type:string,label:string>>,emailAddresses:array<struct<value:string,type:string,label:string>>,"
    "addresses:array<struct<streetAddress:string,city:string,region:string,postalCode:string,country:string,countryCode:string,type:string,label:string>>,"
    "urls:array<struct<value:string,type:string,label:string>>,birthdays:array<struct<date:struct<year:int,month:int,day:int>>>,biographies:array<struct<value:string>>,"
    "photos:array<struct<url:string,metadata:struct<`default`:boolean>>>,memberships:array<struct<contactGroupMembership:struct<contactGroupResourceName:string>>>>>"
)


@dataclass(frozen=True)
class Settings:
    """Choices that change results; the defaults are the product's."""

    sync_deleted: bool = False
    sync_photos: bool = True
    sync_notes: bool = False
    sync_birthday: bool = True
    sync_websites: bool = True
    sync_addresses: bool = True
    sync_job_title: bool = True
    sync_country_codes: bool = True
    merge_one_way: bool = False
    force_update_all: bool = False
    dry_run: bool = False
    confirm_deletions: bool = True
    batch_updates: bool = True
    conflict: str = "alwaysAsk"
    ai_matching: bool = True
    confirm_score: int = 50
    auto_score: int = 80
    score_low: int = 30
    score_high: int = 79
    max_auto_group: int = 3
    history_days: int = 30
    max_events: int = 1000
    max_backups: int = 30
    max_failures: int = 3
    name_format: str = "asIs"
    #: Records of one email or phone beyond which they are paired with the least of them alone (``matching.hot_keys`` lists such keys); None: all pairs.
    max_key_fanout: int | None = None
    #: Families of given names that stand for each other; None is the list of ``functions.name_families``.
    nicknames: tuple[tuple[str, ...], ...] | None = None
