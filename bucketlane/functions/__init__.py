"""Part of bucketlane; see README.md."""
