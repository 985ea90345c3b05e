"""Extensions to streams; everything else works on whole tables."""
