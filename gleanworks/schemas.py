"""Record schemas. Reads always declare one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, MapType,
    StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

_S, _L, _D, _B, _T = StringType(), LongType(), DoubleType(), BooleanType(), TimestampType()


def struct(mandatory: dict | None = None, /, **optional) -> StructType:
    """Fields from keyword arguments; those in ``mandatory`` come first and are not nullable."""
    fields = [StructField(name, kind, False) for name, kind in (mandatory or {}).items()]
    return StructType(fields + [StructField(name, kind, True) for name, kind in optional.items()])


RAW_DATA = struct({"source_id": _S, "ingestion_timestamp": _T, "raw_content": _S}, metadata=_S)
PROCESSED_DATA = struct({
    "document_id": _S, "source_id": _S, "document_type": _S, "processing_timestamp": _T,
    "processed_content": _S, "confidence_score": _D,
})

STORED_FILE = struct(
    name=_S, bucket=_S, size=_L, contentType=_S, metadata=MapType(_S, _S), retentionExpiryDate=_T,
)
RESULT_STORAGE = struct(
    rawFile=STORED_FILE, processedFile=STORED_FILE, bigQueryTable=_S, version=_S,
    compressionType=_S, encryptionKey=_S,
)
STEP_ERROR = struct(code=_S, message=_S, details=_S)
PROCESSING_STEP = struct(
    stepId=_S, operation=_S, timestamp=_T, duration=_L, status=_S, error=STEP_ERROR,
)
QUALITY_METRICS = struct(completeness=_D, accuracy=_D, consistency=_D, freshness=_D)
RESULT_METADATA = struct(
    size=_L, itemCount=_L, format=_S, contentType=_S, checksum=_S, validationStatus=_S,
    qualityMetrics=QUALITY_METRICS, customMetrics=MapType(_S, _D),
    processingHistory=ArrayType(PROCESSING_STEP),
)
SCRAPING_RESULT = struct(
    id=_S, jobId=_S, sourceType=_S, sourceUrl=_S, timestamp=_T,
    storage=RESULT_STORAGE, metadata=RESULT_METADATA,
)

JOB_METRICS = struct(
    requestCount=_L, bytesProcessed=_L, itemsScraped=_L, errorCount=_L, avgResponseTime=_D,
    successRate=_D, bandwidthUsage=_D, retryRate=_D,
)
JOB_ERROR = struct(
    code=_S, category=_S, message=_S, stack=_S, timestamp=_T, retryable=_B, context=MapType(_S, _S),
)
EXECUTION_DETAILS = struct(
    startTime=_T, endTime=_T, duration=_L, attempts=IntegerType(), metrics=JOB_METRICS,
    errors=ArrayType(JOB_ERROR),
)
SELECTOR = struct(selector=_S, type=_S, required=_B)
SCRAPING_CONFIG = struct(
    jobId=_S,
    source=struct(
        type=_S, url=_S, selectors=MapType(_S, SELECTOR),
        authentication=struct(type=_S, credentials=MapType(_S, _S)), headers=MapType(_S, _S),
    ),
    schedule=struct(
        enabled=_B, cronExpression=_S, timezone=_S,
        validation=struct(maxFrequency=_L, minInterval=_L),
    ),
    options=struct(
        retryAttempts=_L, retryDelay=_L, timeout=_L, userAgent=_S,
        rateLimit=struct(requests=_L, period=_L), priority=_S, tags=ArrayType(_S),
    ),
)
SCRAPING_JOB = struct(
    id=_S, config=SCRAPING_CONFIG, status=_S, createdAt=_T, updatedAt=_T,
    executionDetails=EXECUTION_DETAILS, retryCount=IntegerType(), lastRetryAt=_T, version=_L,
)

DOCUMENT_METADATA = struct(
    fileName=_S, mimeType=_S, size=_L, uploadedAt=_T, source=_S, version=_S, retentionPolicy=_S,
    complianceFlags=ArrayType(_S),
)
DOCUMENT = struct(documentId=_S, content=BinaryType(), metadata=DOCUMENT_METADATA, checksum=_S)
PROCESSING_RESULT = struct(
    documentId=_S, status=_S, startTime=_T, endTime=_T, error=_S, retryCount=IntegerType(),
    processingDuration=_L, traceId=_S,
)
OCR_REGION = struct(
    bbox=struct(x=_D, y=_D, width=_D, height=_D), text=_S, confidence=_D,
)
OCR_PAGE = struct(
    pageNumber=IntegerType(), text=_S, confidence=_D, processingTime=_L,
    regions=ArrayType(OCR_REGION),
)
OCR_METRICS = struct(memoryUsage=_D, cpuUtilization=_D, retryCount=IntegerType())
OCR_RESULT = struct(
    documentId=_S, text=_S, confidence=_D, processedAt=_T, processingTime=_L,
    pageResults=ArrayType(OCR_PAGE), metrics=OCR_METRICS,
)
ENTITY = struct(
    text=_S, type=_S, confidence=_D, position=struct(start=_L, end=_L), context=_S, isPII=_B,
)
CATEGORY = struct(
    category=_S, confidence=_D, subcategories=ArrayType(_S), hierarchy=ArrayType(_S),
    rules=ArrayType(_S),
)
NLP_RESULT = struct(
    documentId=_S, entities=ArrayType(ENTITY), classifications=ArrayType(CATEGORY),
    confidence=_D, processedAt=_T, processingTime=_L, piiDetected=_B, modelVersion=_S,
)

DATA_METADATA = struct(
    sourceId=_S, sourceType=_S, classification=_S, createdAt=_T, retentionPeriod=_L,
    encryptionStatus=_B, jurisdiction=_S, lastModifiedAt=_T, lastModifiedBy=_S,
)
DATA_RECORD = struct(
    id=_S, content=MapType(_S, _S), metadata=DATA_METADATA, version=_S, checksum=_S,
)
ENCRYPTED_VALUE = struct(
    data=BinaryType(), iv=BinaryType(), keyVersion=IntegerType(), timestamp=_T,
    metadata=MapType(_S, _S),
)
ACCESS_LOG = struct(
    requestId=_S, method=_S, path=_S, query=MapType(_S, _S), headers=MapType(_S, _S),
    userAgent=_S, ip=_S, user=_S, startedAt=_T, duration=_D, statusCode=IntegerType(),
    responseTime=_D, responseSize=_L,
)
METRIC_POINT = struct(name=_S, value=_D, timestamp=_T, labels=MapType(_S, _S))

# The operational event feed as it is stored (timestamps carry no zone).
EVENTS = struct(
    event_id=_L, ts=TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S,
)
