"""Schemas of the corpus tables, as DDL."""

RAW_ITEM = "id string, sourceId string, externalId string, medium string, title string, description string, publishedAt string, url string, audioUrl string, imageUrl string, fetchedAt string"
SEGMENT = "struct<id: string, start: double, end: double, speaker: string, text: string, words: array<struct<text: string, start: double, end: double, confidence: double>>, providerSegmentId: string>"
LEGACY_TRANSCRIPT = "id string, rawItemId string, sourceId string, title string, audioUrl string, transcribedAt string, model string, language string, segmentCount int, text string"
RAW_TRANSCRIPT = f"id string, rawItemId string, sourceId string, provider string, model string, language string, transcribedAt string, audioUrl string, segments array<{SEGMENT}>, text string, warnings array<string>"
NORMALIZED_TRANSCRIPT = RAW_TRANSCRIPT + ", normalizedAt string, corrections array<struct<`from`: string, `to`: string, reason: string, count: int>>"
TOPIC_SEGMENT = "id string, rawItemId string, sourceId string, title string, start double, end double, text string, speakerIds array<string>, topics array<string>, mentionedAssets array<string>, importance string"
ENTITY = "id string, canonicalName string, aliases array<string>, type string, ticker string, exchange string, evidenceSegmentIds array<string>"
CLAIM = "id string, rawItemId string, segmentId string, claim string, claimType string, entities array<string>, tickers array<string>, sentiment string, confidence double, evidence struct<start: double, end: double, quote: string>"
INSIGHT = "id string, rawItemId string, watchlistKey string, title string, summary string, relatedTickers array<string>, claimIds array<string>, riskLevel string"
SUMMARY = "id string, sourceId string, sourceName string, sourceSlug string, title string, url string, publishedAt string, summarizedAt string, excerpt string, keyPoints array<string>, body string, topics array<string>, mentionedAssets array<string>, sentiment string, risks array<string>, sourceTextQuality string"
PROBE = "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, sample_rate: string, channels: int, duration: string>>"
MANIFEST = "id string, rawItemId string, sourceId string, audioUrl string, fetchedAt string, metadata struct<durationSeconds: double, codec: string, sampleRate: int, channels: int, warnings: array<string>>, preprocessing struct<targetSampleRate: int, channels: int, bitrate: string, segmentSeconds: int, vadEnabled: boolean, strategy: string, warnings: array<string>>, chunks array<struct<index: int, file: string, start: double, end: double, boundary: string>>"
