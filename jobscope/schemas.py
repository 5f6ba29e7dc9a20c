"""State lists, entity schemas and limits shared by the operators."""

# Job states and their groups.
STATES = ["available", "active", "completed", "retryable", "scheduled", "discarded", "cancelled"]
TERMINAL_STATES = ["completed", "discarded", "cancelled"]
IMPORTABLE_STATES = ["available", "scheduled", "retryable"]
WAITING_STATES = ["available", "scheduled", "retryable"]

# Version of the export document, batch sizes, default limits.
EXPORT_VERSION = "1.0"
NDJSON_BATCH = 100
SEARCH_LIMIT = 25
FAILURE_LIMIT = 20
BOTTLENECK_LIMIT = 10
CRON_HISTORY_LIMIT = 10
ERROR_WIDTH = 60
SHORT_ID = 12

CANONICAL_JOB = (
    "type string, queue string, args string, priority int, scheduled_at string, meta string"
)
LIVE_JOB = (
    "id string, type string, queue string, state string, args variant, priority int, "
    "attempt int, max_attempts int, created_at string, enqueued_at string, "
    "scheduled_at string, completed_at string"
)
KEYSPACE = "key string, kind string, idx bigint, field string, value string, score double"
EXPORT_DOCUMENT = (
    "version string, source struct<backend:string,url:string,version:string>, exported_at string, "
    "options struct<include_completed:boolean,include_dead_letter:boolean,queues:array<string>,since:string>, "
    f"jobs array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in LIVE_JOB.split(','))}>>, "
    "stats struct<total_jobs:bigint,by_state:map<string,bigint>,by_queue:map<string,bigint>>"
)
BULLMQ_CONFIG = (
    "queues array<struct<name:string,jobs:array<struct<name:string,opts:struct<attempts:int,"
    "delay:bigint,backoff:struct<type:string,delay:bigint>>>>>>"
)
CELERY_CONFIG = (
    "task_routes map<string,struct<queue:string>>, "
    "task_annotations map<string,struct<max_retries:int,rate_limit:string>>, "
    "beat_schedule map<string,struct<task:string,schedule:struct<crontab:string>>>"
)
SIDEKIQ_WORKERS = "array<struct<class:string,queue:string,retry:string,cron:string>>"
CONVERTED_CONFIG = (
    "source string, jobs array<struct<type:string,queue:string,options:struct<queue:string,"
    "max_attempts:int,retry:struct<max_attempts:int,backoff:string,delay_ms:int>>,cron:string>>, "
    "warnings array<string>"
)
MANIFEST = (
    "version string, package string, job_types array<struct<type:string,description:string,queue:string,"
    "args:array<struct<name:string,type:string,description:string,required:boolean>>,"
    "retry:struct<max_attempts:int,backoff:string,initial_ms:int>,unique:struct<key:string,period:string>,"
    "timeout_ms:int,priority:int,tags:array<string>,meta:map<string,string>>>"
)
