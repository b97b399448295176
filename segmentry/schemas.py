"""Table schemas, required columns and JSON feed schemas."""

from __future__ import annotations

CHARTS = (
    "app_id string, title string, developer string, release_date string, primary_genre string, "
    "genres string, artwork_url string, app_store_url string, chart_type string, chart_position int, "
    "country string, snapshot_date string, source_url string"
)
REVIEWS = (
    "app_id string, game_title string, developer string, review_id string, reviewer string, "
    "review_title string, review_text string, review_rating int, review_date string, "
    "review_version string, country string"
)
COVERAGE = (
    "app_id string, game_title string, developer string, reviews_collected long, "
    "pages_collected long, request_failed boolean"
)
CLUSTER_SUMMARY = (
    "cluster_id int, game_count long, developer_count long, average_rating double, "
    "median_rating_count double, average_chart_position double, free_game_share double, "
    "keywords string, representative_games string"
)
OPPORTUNITIES = (
    "opportunity_rank int, " + CLUSTER_SUMMARY + ", top_developer string, top_developer_share double, "
    "semantic_coherence double, cluster_name string, market_strength_score double, "
    "player_validation_score double, competition_gap_score double, developer_diversity_score double, "
    "semantic_coherence_score double, confidence_score double, opportunity_score double, "
    "confidence_level string, segment_type string, warning string, signal_summary string, "
    "ranking_penalty double, adjusted_opportunity_score double"
)
PAIN_POINT_SUMMARY = (
    "pain_point_id int, review_count long, share_of_negative_reviews double, average_rating double, "
    "game_count long, keywords string, representative_reviews string"
)
CLUSTER_PAIN_POINTS = (
    "cluster_id int, pain_point_id int, review_count long, cluster_negative_reviews long, "
    "pain_point_share double, sufficient_review_coverage boolean"
)
METADATA = (
    "app_id string, lookup_title string, lookup_developer string, description string, "
    "primary_genre string, detailed_genres string, average_rating double, rating_count double, "
    "current_version_rating double, current_version_rating_count double, price double, "
    "currency string, formatted_price string, release_date timestamp, last_update_date timestamp, "
    "version string, minimum_os_version string, content_rating string, seller_name string, "
    "bundle_id string, file_size_bytes double, supported_devices string, language_codes string, "
    "artwork_url_512 string, lookup_app_store_url string, has_in_app_purchases boolean"
)
ENRICHED = (
    "app_id string, title string, developer string, release_date_x string, primary_genre_x string, "
    "genres string, artwork_url string, app_store_url string, chart_type string, chart_position int, "
    "country string, snapshot_date string, source_url string, lookup_title string, "
    "lookup_developer string, description string, primary_genre_y string, detailed_genres string, "
    "average_rating double, rating_count double, current_version_rating double, "
    "current_version_rating_count double, price double, currency string, formatted_price string, "
    "release_date_y timestamp, last_update_date timestamp, version string, minimum_os_version string, "
    "content_rating string, seller_name string, bundle_id string, file_size_bytes double, "
    "supported_devices string, language_codes string, artwork_url_512 string, "
    "lookup_app_store_url string, has_in_app_purchases boolean, metadata_found boolean"
)
CLUSTERED = ENRICHED + ", cleaned_text string, cluster_id int"

# table -> (schema, columns a reader may rely on)
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "enriched_games": (ENRICHED, ("app_id", "title", "developer", "chart_type", "chart_position")),
    "clustered_games": (CLUSTERED, ("app_id", "title", "developer", "cluster_id")),
    "cluster_summary": (CLUSTER_SUMMARY, ("cluster_id", "game_count", "keywords", "representative_games")),
    "opportunities": (OPPORTUNITIES, ("cluster_id", "cluster_name", "adjusted_opportunity_score",
                                      "segment_type", "representative_games")),
    "reviews": (REVIEWS, ("app_id", "game_title", "review_text", "review_rating")),
    "review_coverage": (COVERAGE, ("app_id", "game_title", "reviews_collected")),
    "pain_point_summary": (PAIN_POINT_SUMMARY, ("pain_point_id", "keywords", "representative_reviews")),
    "cluster_pain_points": (CLUSTER_PAIN_POINTS, ("cluster_id", "pain_point_id", "pain_point_share")),
}

_LABEL = "struct<label:string>"
_ATTRIBUTES = "struct<attributes:struct<label:string>>"

# Field names of the landed JSON documents.
CHART_ENTRY = (
    "struct<id:struct<label:string,attributes:struct<`im:id`:string>>,"
    f"`im:name`:{_LABEL},`im:artist`:{_LABEL},`im:releaseDate`:{_ATTRIBUTES},"
    f"category:{_ATTRIBUTES},`im:image`:array<{_LABEL}>>"
)
REVIEW_ENTRY = (
    f"struct<`im:rating`:{_LABEL},content:{_LABEL},title:{_LABEL},id:{_LABEL},updated:{_LABEL},"
    f"`im:version`:{_LABEL},author:struct<name:{_LABEL}>>"
)
LOOKUP_RECORD = (
    "struct<trackId:string,trackName:string,artistName:string,description:string,"
    "primaryGenreName:string,genres:string,averageUserRating:string,userRatingCount:string,"
    "averageUserRatingForCurrentVersion:string,userRatingCountForCurrentVersion:string,price:string,"
    "currency:string,formattedPrice:string,releaseDate:string,currentVersionReleaseDate:string,"
    "version:string,minimumOsVersion:string,contentAdvisoryRating:string,sellerName:string,"
    "bundleId:string,fileSizeBytes:string,supportedDevices:array<string>,"
    "languageCodesISO2A:array<string>,artworkUrl512:string,trackViewUrl:string,features:string>"
)
# output column -> record field, in output order (text, number, timestamp, list)
LOOKUP_TEXT = {
    "lookup_title": "trackName", "lookup_developer": "artistName", "description": "description",
    "primary_genre": "primaryGenreName", "currency": "currency", "formatted_price": "formattedPrice",
    "version": "version", "minimum_os_version": "minimumOsVersion",
    "content_rating": "contentAdvisoryRating", "seller_name": "sellerName", "bundle_id": "bundleId",
    "artwork_url_512": "artworkUrl512", "lookup_app_store_url": "trackViewUrl",
}
LOOKUP_NUMBERS = {
    "average_rating": "averageUserRating", "rating_count": "userRatingCount",
    "current_version_rating": "averageUserRatingForCurrentVersion",
    "current_version_rating_count": "userRatingCountForCurrentVersion", "price": "price",
    "file_size_bytes": "fileSizeBytes",
}
LOOKUP_TIMES = {"release_date": "releaseDate", "last_update_date": "currentVersionReleaseDate"}
LOOKUP_LISTS = {"supported_devices": "supportedDevices", "language_codes": "languageCodesISO2A"}
