"""Controlled vocabularies, order tables and the explicit schemas of the tables that the operators read."""

from __future__ import annotations

# Fixed values of the domain.
TOPICS = ("intro_consent", "experiences", "services", "challenges", "sustainability")
ROLES = ("participant", "interviewer", "unassigned")
STANCES = ("positive", "negative", "mixed", "neutral", "na")
WEIGHTS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)
DISCORD_TYPES = ("", "positive_words_flat_voice", "negative_words_bright_voice")

ASR = (
    "session_id string, asr_model string, language string, language_probability double, duration_s double, elapsed_s double, "
    "segments array<struct<id:int,start_s:double,end_s:double,text:string,avg_logprob:double,no_speech_prob:double,"
    "words:array<struct<w:string,s:double,e:double,p:double>>>>"
)
DIARIZATION = (
    "session_id string, n_speakers_est int, n_turns int, speaker_seconds map<string,double>, "
    "turns array<struct<spk:int,start_s:double,end_s:double,text:string>>, words array<struct<s:double,e:double,w:string,seg:int,spk:int>>"
)
UTTERANCES = (
    "utt_id string, session_id string, participant_id string, speaker_raw string, speaker_role string, turn_index int, seg_index int, "
    "start_s double, end_s double, duration_s double, text string, n_words int, n_chars int, words_per_s double, is_backchannel int, "
    "interview_date string, recording_device string, duration_min double"
)
SESSIONS = (
    "session_id string, source_file string, interview_date string, interview_time string, src_codec string, src_sample_rate int, "
    "src_channels int, src_bitrate_kbps int, recording_device string, duration_min double, wav_16k_path string"
)
CLEANED_TURNS = "session_id string, turn_index int, source_docx string, speaker_label string, speaker_role string, participant_id string, text string"
CODED = "utt_id string, code_ids string, code_names string, n_codes int, llm_stance string, key_phrase string, code_confidence string"
SCHEMAS = {"asr": ASR, "diarization": DIARIZATION, "utterances": UTTERANCES, "sessions": SESSIONS, "cleaned_turns": CLEANED_TURNS, "coded": CODED}
