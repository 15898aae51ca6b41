"""Spark-native analytics over source trees and the records derived from them."""
