"""Line files, structured scans, annotated files and sinks."""
