"""noticemill: procurement-notice analytics as Spark jobs."""
