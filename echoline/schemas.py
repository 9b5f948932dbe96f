"""Schemas of the engine's tables. Times are seconds on the media's own clock."""

TARGETS = "query_id long, text string"
WORDS = "media_id long, model string, word_idx int, text string, start double, end double, probability double"
CUES = "media_id long, source string, language string, cue_idx int, text string, start double, end double"
TRACKS = "media_id long, source string, track_pos int, language string, name string, extension string, url string, protocol string, impersonate string, http_headers map<string,string>"
MEDIA = "media_id long, duration double, has_video boolean, has_audio boolean, embedded_subtitles array<struct<index:int,codec:string,language:string,title:string>>, width int, height int, video_codec string, audio_codec string, avg_frame_rate string, real_frame_rate string, video_time_base string, video_start_time double, audio_start_time double"
FRAMES = "media_id long, decode_idx int, pts long, time_base string, timestamp double, image_digest string"
OCR_LINES = "media_id long, decode_idx int, line_idx int, text string, confidence double"
TRANSCRIPTS = "media_id long, words array<struct<text:string,start:double,end:double>>"
OCCURRENCES = "query_id long, media_id long, occ_idx int, matched_text string, start double, end double, match_type string, score double"
